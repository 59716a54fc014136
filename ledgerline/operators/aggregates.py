"""Grouped aggregations.  All are built-in aggregate expressions, so Spark runs
them as partial (map-side) + final aggregates around one shuffle on the keys."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.exprs import col, safe_div


def daily_avg(df: DataFrame, ts: str, value: str, out: str = "avg_value", day_col: str = "day") -> DataFrame:
    return df.groupBy(F.to_date(F.col(ts)).alias(day_col)).agg(F.avg(value).alias(out))


def daily_sum(df: DataFrame, ts: str, cols: Mapping[str, str] | Sequence[str], day_col: str = "day") -> DataFrame:
    named = cols if isinstance(cols, Mapping) else {c: c for c in cols}
    return df.groupBy(F.to_date(F.col(ts)).alias(day_col)).agg(
        *[F.sum(src).alias(name) for name, src in named.items()])


def sum_where(measures: Mapping[str, tuple]) -> list[Column]:
    """``SUM(CASE WHEN cond THEN expr [ELSE 0] END)`` for many measures in one pass.

    ``measures``: name -> (cond, expr) or (cond, expr, else_value); else_value None
    means no ELSE (NULL when nothing matches)."""
    out = []
    for name, spec in measures.items():
        cond, expr = spec[0], spec[1]
        other = spec[2] if len(spec) > 2 else 0
        w = F.when(cond, col(expr))
        if other is not None:
            w = w.otherwise(F.lit(other))
        out.append(F.sum(w).alias(name))
    return out


def count_distinct_where(measures: Mapping[str, tuple]) -> list[Column]:
    """``COUNT(DISTINCT CASE WHEN cond THEN id END)`` for several measures per group."""
    return [F.count_distinct(F.when(cond, col(idc))).alias(name) for name, (cond, idc) in measures.items()]


def distinct_count(df: DataFrame, by: Sequence[str], cols: Mapping[str, str], approx: bool = False,
                   rsd: float = 0.01) -> DataFrame:
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    return df.groupBy(*by).agg(*[fn(F.col(c)).alias(name) for name, c in cols.items()])


def cost_basis(spend: Column, grant: Column, coalesce_denominator: bool = True) -> Column:
    """Spend / grants aggregated per group; NULL-safe ratio."""
    den = F.sum(F.coalesce(grant, F.lit(0))) if coalesce_denominator else F.sum(grant)
    return safe_div(F.sum(spend), den)


def first_last(df: DataFrame, key: str, label: str, order: str,
               first_name: str = "first_value", last_name: str = "last_value") -> DataFrame:
    """min_by / max_by with a unique tie-break (order, label) so every engine agrees."""
    return df.groupBy(key).agg(
        F.min(F.struct(F.col(order), F.col(label)))[label].alias(first_name),
        F.max(F.struct(F.col(order), F.col(label)))[label].alias(last_name),
    )


def group_size(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def cluster_profile(df: DataFrame, features: Sequence[str], cluster_col: str = "cluster") -> DataFrame:
    """Mean of every numeric feature per cluster (names absent from the frame are skipped)."""
    present = [f for f in features if f in df.columns]
    return df.groupBy(cluster_col).agg(*[F.avg(f).alias(f) for f in present])


def window_avg(df: DataFrame, date_col: str, value: str, start, end, keys: Sequence[str] = (),
               out: str | None = None) -> DataFrame:
    """Sum per (keys, day) in [start, end), then mean over the days present
    (missing days are not zeros); a key with no rows is simply absent (NULL after a join)."""
    out = out or f"{value}_avg"
    daily = (df.filter((F.col(date_col) >= F.lit(start)) & (F.col(date_col) < F.lit(end)))
               .groupBy(*keys, date_col).agg(F.sum(value).alias("_d")))
    return daily.groupBy(*keys).agg(F.avg("_d").alias(out))


def grand_total(df: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in measures.items()])


def by_year(df: DataFrame, date_col: str, measures: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.year(date_col).alias("year")).agg(*[F.sum(m).alias(m) for m in measures])


def join_text(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str = "\n",
              out: str = "text") -> DataFrame:
    """Ordered concatenation per group.  Each group is one (channel, day) document;
    there is never a single global string."""
    ordered = F.sort_array(F.collect_list(F.struct(*[F.col(o) for o in order], F.col(text).alias("_t"))))
    return df.filter(F.col(text).isNotNull()).groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda s: s["_t"]), sep).alias(out))


def model_range(cols: Sequence[str]) -> tuple[Column, Column]:
    return F.least(*[F.col(c) for c in cols]), F.greatest(*[F.col(c) for c in cols])


def day_sketches(df: DataFrame, day: str, user: str, keys: Sequence[str] = (), lg_k: int = 14) -> DataFrame:
    """One HyperLogLog sketch of ``user`` per (keys, day) - a few kilobytes to store and merge, however many rows a day has."""
    return df.groupBy(*keys, day).agg(F.hll_sketch_agg(user, lg_k).alias("sketch"))


def active_over(sketches: DataFrame, day: str, windows: Sequence[int], keys: Sequence[str] = (), name: str = "active") -> DataFrame:
    """Estimated distinct users of the last 1, 7, 30 ... days (``windows``) up to each day that has a sketch, by merging stored day
    sketches: a day's sketch goes to the days it counts for, at most the longest window's number, and the facts are not read again.  The standard error
    of a sketch with ``lg_k`` = 14 is under 1 %."""
    last = max(windows)
    spread = sketches.select(*keys, F.col("sketch"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(last - 1)), lambda i: F.date_add(F.col(day), i))).alias("back", "_to"))
    merged = spread.groupBy(*keys, F.col("_to").alias(day)).agg(*[
        F.hll_sketch_estimate(F.hll_union_agg(F.when(F.col("back") < w, F.col("sketch")))).alias(f"{name}_{w}") for w in windows])
    return merged.join(sketches.select(*keys, day), [*keys, day], "left_semi")
