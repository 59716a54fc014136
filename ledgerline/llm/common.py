"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.session import checkpoint_dir

#: A word, and the characters between words (fixed values).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; a rerun never meets an earlier run's files."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.  Cuts lineage (no task is
    ever recomputed from further back than these files) and gives Catalyst the true size,
    so a join on it broadcasts only if the files are under autoBroadcastJoinThreshold."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column, chunk: int = 128) -> Column:
    """The sums of an int array up to each element, in two levels so that long arrays stay cheap."""
    def sums(a):
        return F.aggregate(a, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
                           lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")))

    def whole(v):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int")), lambda c: sums(F.slice(v, c * chunk + 1, F.lit(chunk))))

        def joined(p):
            ends = sums(F.transform(p, lambda x: x["at"]))["out"]
            return let(ends, lambda e: F.flatten(F.zip_with(p, e, lambda x, end: F.transform(x["out"], lambda o: o + end - x["at"]))))

        return F.when(F.size(v) > 0, let(parts, joined)).otherwise(F.array().cast("array<int>"))

    return let(values, whole)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(c: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")
