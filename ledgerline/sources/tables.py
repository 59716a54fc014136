"""Table sources.  Reads are lazy: Catalyst prunes columns and pushes filters
into the Parquet scan, so a reader never needs to pre-select columns itself."""

from __future__ import annotations

import os
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(base: str, name: str) -> str:
    p = os.path.join(base, f"{name}.parquet")
    return p if os.path.exists(p) or "://" in base else os.path.join(base, name)


def _scan(spark: SparkSession, name: str, base: str | None) -> DataFrame:
    """A lazy scan; listed anew each time, so replaced or appended files are seen."""
    return spark.read.parquet(table_path(base, name)) if base else spark.table(name)


def read_table(spark: SparkSession, name: str, base: str | None = None, schema: StructType | None = None,
               columns: Iterable[str] | None = None) -> DataFrame:
    """A table by catalog name, or Parquet under ``base``.  With ``schema`` the
    declared columns must exist (fail early) and are cast to the declared types."""
    df = _scan(spark, name, base)
    if schema is not None:
        missing = [f.name for f in schema.fields if f.name.lower() not in {c.lower() for c in df.columns}]
        if missing:
            raise ValueError(f"table {name} lacks columns {missing}")
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    if columns is not None:
        df = df.select(*columns)
    return df


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """Reopen the stored output of an earlier job."""
    return spark.read.parquet(path)


def read_policies(spark: SparkSession, path: str, fmt: str = "parquet", date_col: str = "Effective_Date",
                  schema: StructType | str | None = None) -> DataFrame:
    """Policy-level rows (CSV or Parquet) with the effective date parsed to a date."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.option("header", True).csv(path) if fmt == "csv" else r.format(fmt).load(path)
    return df.withColumn(date_col, F.to_date(F.col(date_col)))


def recent_messages(df: DataFrame, as_of, hours: int = 24, ts_col: str = "ts") -> DataFrame:
    """The last ``hours`` of messages up to ``as_of`` (inclusive cutoff), newest first."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_interval(hours=F.lit(hours))
    return df.filter((F.col(ts_col) >= cutoff) & (F.col(ts_col) <= F.lit(as_of).cast("timestamp_ntz"))) \
             .orderBy(F.col(ts_col).desc())
