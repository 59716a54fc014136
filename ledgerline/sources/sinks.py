"""Sinks.  Appends are partitioned by run date and use dynamic partition
overwrite so a rerun of the same date replaces, never duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def append_snapshot(df: DataFrame, path: str, run_date, col: str = "run_date") -> DataFrame:
    out = df.withColumn(col, F.to_date(F.lit(str(run_date))))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(col).parquet(path)
    return df.sparkSession.read.parquet(path)


def replace_table(df: DataFrame, path_or_table: str, as_table: bool = False) -> None:
    if as_table:
        df.writeTo(path_or_table).createOrReplace()
    else:
        df.write.mode("overwrite").parquet(path_or_table)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_model(model, path: str) -> None:
    """Persist a fitted ``PipelineModel`` (scaler, PCA, K-Means) on any Hadoop FS."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
