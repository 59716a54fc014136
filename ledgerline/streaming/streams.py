"""Structured Streaming variants of the stateless and windowed operators.

The source jobs are batch pulls (a 24-hour window, an append per run date).
These run the same column expressions on an unbounded input:
* message cleaning and model assignment are stateless maps;
* daily grants per user use an event-time window with a watermark, so state
  for a day is dropped once the watermark passes it.  Exact distinct counts are
  not supported on streams, hence ``approx_count_distinct`` (a sketch) here,
  while the batch operator stays exact.
Sinks checkpoint into the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ledgerline.functions.exprs import clean_message, scalar_json
from ledgerline.session import checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema: StructType | str, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def clean_stream(stream: DataFrame, col: str = "text", out: str = "clean_content") -> DataFrame:
    """Stateless: the batch cleaner applied to every arriving row."""
    return stream.withColumn(out, clean_message(col))


def assign_stream(stream: DataFrame, model) -> DataFrame:
    """Stateless: a fitted (frozen) PipelineModel applied to arriving rows."""
    return model.transform(stream)


def daily_grants_stream(stream: DataFrame, ts: str = "created_at", user: str = "user_id", amount: str = "amount",
                        pattern: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Grants per (day window, user) with a watermark for late rows."""
    s = stream
    if pattern is not None:
        s = s.filter(F.lower(scalar_json("extra", "$.sourceString")).like(pattern))
    return (s.withWatermark(ts, lateness)
             .groupBy(F.window(ts, "1 day").alias("day"), user)
             .agg(F.approx_count_distinct("id").alias("reward_txs"), F.sum(amount).alias("daily_reward")))


def start(df: DataFrame, name: str, mode: str = "append", fmt: str = "memory", path: str | None = None):
    """Start a query with a checkpoint in the shared checkpoint folder."""
    ck = os.path.join(checkpoint_dir(df.sparkSession), "streams", name)
    w = df.writeStream.outputMode(mode).option("checkpointLocation", ck)
    if fmt == "memory":
        return w.format("memory").queryName(name).start()
    return w.format(fmt).option("path", path).start()
