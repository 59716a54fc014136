"""Set operations and reshaping."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def union_padded(a: DataFrame, b: DataFrame, fill=0) -> DataFrame:
    """UNION ALL by name; measures missing on one side are filled on THAT side only
    (a NULL that is real data on the other side stays NULL)."""
    a_missing = [c for c in b.columns if c not in a.columns]
    b_missing = [c for c in a.columns if c not in b.columns]
    a2 = a.withColumns({c: F.lit(fill).cast(b.schema[c].dataType) for c in a_missing})
    b2 = b.withColumns({c: F.lit(fill).cast(a.schema[c].dataType) for c in b_missing})
    return a2.unionByName(b2)


def node_index(df: DataFrame, a: str, b: str, label: str = "label", idx: str = "node") -> DataFrame:
    """Distinct labels of two columns -> 0-based integer index (ordered by label)."""
    labels = df.select(F.col(a).alias(label)).union(df.select(F.col(b).alias(label))).distinct()
    return labels.withColumn(idx, F.row_number().over(Window.orderBy(F.col(label).asc_nulls_first())) - 1)


def unpivot_nonnull(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "member_col",
                    value: str = "member") -> DataFrame:
    """Wide member columns -> one value column; NULL members are dropped (SQL UNPIVOT)."""
    return df.unpivot(list(ids), list(cols), name, value).filter(F.col(value).isNotNull())


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "model", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def transition_matrix(df: DataFrame, row: str, col: str, labels: Sequence[str]) -> DataFrame:
    """Pair counts as a matrix; labels are given so the pivot needs no extra job."""
    return df.groupBy(row).pivot(col, list(labels)).count().fillna(0)
