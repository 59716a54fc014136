"""A training-data pipeline over ``documents``: reject poor documents, keep one of each group of near
copies, drop benchmark leaks, mix sources to target weights, write bit-packed token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
back as the next stage's documents, so a lost executor never costs more than one stage.

Nulls in any column are kept as such: a null text counts as empty, a null source or lang as a value of its own, and a null
doc_id orders last where one document of a group stays.  Rows equal in doc_id and text are one document to the near-dedup stage.  Very long texts are
read whole; ties fall to the smallest doc_id, then to the seeded hash.  Empty tables give an empty result.  Other columns, also ones whose names the
stages use inside, pass through every stage but the last, which returns the token table alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm import decontaminate, mixing, quality, simhash, token_output
from ledgerline.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_id_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.token_table(docs)


STAGES = [("quality classifier", quality_classifier), ("SimHash near-dedup", simhash_near_dedup),
          ("benchmark decontamination", benchmark_decontamination), ("mixing sources to target weights", mixing_sources),
          ("token-ID / binary output", token_id_output)]

#: Classifier, fingerprints and tokenizer have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
