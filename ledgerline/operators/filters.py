"""Projections and predicates.  All plain Catalyst expressions, so filters reach
the Parquet scan (PushedFilters) and unused columns are pruned (ReadSchema)."""

from __future__ import annotations

import datetime as _dt
from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.exprs import col, row_sum


def with_derived(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """``SELECT *, <computed columns>``."""
    return df.withColumns(dict(exprs))


def keep_cols(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Keep the named columns that exist, in the given order; absent names are ignored."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[have[c.lower()] for c in cols if c.lower() in have])


def drop_cols(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def with_const(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def scan_window(df: DataFrame, date_col: str, start, end) -> DataFrame:
    """Inclusive ``[start, end]`` (SQL BETWEEN with bound parameters)."""
    return df.filter(F.col(date_col).between(F.lit(start), F.lit(end)))


def between_days(df: DataFrame, date_col: str, start, end) -> DataFrame:
    """Half-open ``[start, end)`` day window."""
    return df.filter((F.col(date_col) >= F.lit(start)) & (F.col(date_col) < F.lit(end)))


def since(df: DataFrame, ts_col: str, as_of, days: int, strict: bool = True) -> DataFrame:
    """Rows newer than ``as_of - days``.  ``as_of`` is a parameter (never
    ``current_timestamp()``) so reruns and tests are reproducible."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))
    c = F.col(ts_col)
    return df.filter(c > cutoff if strict else c >= cutoff)


def slices(df: DataFrame, date_col: str, run_date) -> DataFrame:
    """Tag rows as today / yesterday / last-7 / last-30 in one pass (no re-scan)."""
    d = F.col(date_col)
    rd = F.to_date(F.lit(run_date))
    return df.withColumns({
        "is_today": d == rd,
        "is_yday": d == F.date_sub(rd, 1),
        "in_7d": (d >= F.date_sub(rd, 7)) & (d < rd),
        "in_30d": (d >= F.date_sub(rd, 30)) & (d < rd),
    })


def tiered_rate_expr(game, type_, subtype, price, qty, rates: Mapping[str, Mapping[tuple, float]],
                     primary_game: str) -> tuple[Column, Column]:
    """Nested CASE for commission rates.

    ``rates`` = {"primary_game": {(type, subtype|None): rate}, "other": {...}}.
    Returns (revenue of the primary game, revenue of the platform).  The primary
    CASE has no ELSE, so rows of other (or NULL) games give NULL, which a SUM skips.
    """
    amount = col(price) * col(qty)

    def inner(table: Mapping[tuple, float]) -> Column:
        out = None
        for (t, st), r in table.items():
            cond = col(type_) == F.lit(t)
            if st is not None:
                cond = cond & (col(subtype) == F.lit(st))
            out = F.when(cond, F.lit(r) * amount) if out is None else out.when(cond, F.lit(r) * amount)
        return out.otherwise(F.lit(0.0))

    is_primary = col(game) == F.lit(primary_game)
    primary = F.when(is_primary, inner(rates["primary_game"]))
    platform = F.when(is_primary, inner(rates["primary_game"])).when(
        col(game) != F.lit(primary_game), inner(rates["other"]))
    return primary, platform


def split_population(df: DataFrame, features: Iterable[str], cluster_col: str = "cluster",
                     free_label: int = -1) -> DataFrame:
    """Row total over the features: zero -> free-to-play (cluster -1); positive ->
    to be modelled (cluster NULL).  Negative totals are dropped, as in the source."""
    total = row_sum(features)
    return (df.withColumn("_total", total)
              .filter(F.col("_total") >= 0)
              .withColumn(cluster_col, F.when(F.col("_total") == 0, F.lit(free_label)))
              .drop("_total"))


def today_str(d) -> str:
    return d.isoformat() if isinstance(d, (_dt.date, _dt.datetime)) else str(d)
