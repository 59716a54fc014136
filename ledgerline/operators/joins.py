"""Joins.  No broadcast hint is placed on inputs whose size grows with the data:
Spark's own size check (``autoBroadcastJoinThreshold`` against plan statistics,
re-checked at runtime by AQE) picks broadcast or sort-merge.  An explicit
``broadcast`` is used only where the frame is bounded by construction
(one-row thresholds, k centroids, fixed lookup tables)."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F



def left_on_expr(a: DataFrame, b: DataFrame, key_expr: Column, key: str, how: str = "left") -> DataFrame:
    """Compute the key on ``a`` first (e.g. ``date(created_at)`` or a hash), then equi-join."""
    return a.withColumn(key, key_expr).join(b, on=key, how=how)


def full_on(a: DataFrame, b: DataFrame, key: str, a_alias: str = "a", b_alias: str = "b") -> DataFrame:
    """FULL OUTER JOIN on ``key`` with ``coalesce(a.key, b.key) AS key``."""
    x, y = a.alias(a_alias), b.alias(b_alias)
    joined = x.join(y, F.col(f"{a_alias}.{key}") == F.col(f"{b_alias}.{key}"), "full_outer")
    rest = [F.col(f"{a_alias}.{c}") for c in a.columns if c != key] + \
           [F.col(f"{b_alias}.{c}") for c in b.columns if c != key]
    return joined.select(F.coalesce(F.col(f"{a_alias}.{key}"), F.col(f"{b_alias}.{key}")).alias(key), *rest)


def outer_chain(parts: Sequence[tuple[DataFrame, str]], key: str, key_from: Sequence[int] | None = None,
                keep_keys: bool = False) -> DataFrame:
    """N-way chain ``t0 [how1] t1 ON coalesce(keys so far) = t1.key ...``.

    ``parts[0]`` is the driving frame (its ``how`` is ignored).  ``key_from`` lists
    which part indexes feed the running coalesce (defaults to all so far); this
    reproduces SQL that coalesces only some sources.  Null keys never match and
    rows fan out on duplicate keys, exactly as in SQL.  Every part's key column is
    renamed ``<key>__<i>``; the result has ``key`` = coalesce over ``key_from``.
    """
    frames = [df.withColumnRenamed(key, f"{key}__{i}") for i, (df, _) in enumerate(parts)]
    out = frames[0]
    feed = list(key_from) if key_from is not None else None
    for i in range(1, len(frames)):
        srcs = [j for j in (feed if feed is not None else range(i)) if j < i]
        running = F.coalesce(*[F.col(f"{key}__{j}") for j in srcs]) if len(srcs) > 1 else F.col(f"{key}__{srcs[0]}")
        out = out.join(frames[i], running == F.col(f"{key}__{i}"), parts[i][1])
    srcs = feed if feed is not None else list(range(len(frames)))
    out = out.withColumn(key, F.coalesce(*[F.col(f"{key}__{j}") for j in srcs]))
    if not keep_keys:
        out = out.drop(*[f"{key}__{i}" for i in range(len(frames))])
    return out


def link_on_text(a: DataFrame, b: DataFrame, a_col: str, b_col: str, key: str = "key_norm",
                 how: str = "inner") -> DataFrame:
    """Normalise a text column on both sides (``clean_key``) and join on it."""
    from ledgerline.functions.exprs import clean_key
    return a.withColumn(key, clean_key(a_col)).join(b.withColumn(key, clean_key(b_col)), key, how)


def on_calendar(df: DataFrame, key_cols: Sequence[str], date_col: str, start: str, end: str,
                fill: dict | None = None, step: str = "1 MONTH") -> DataFrame:
    """Reindex to a complete calendar per key: spine = distinct keys x
    ``sequence(start, end, step)`` (bounded: #keys x #periods), left-joined."""
    dates = F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr(f"INTERVAL {step}")))
    if key_cols:
        spine = df.select(*key_cols).distinct().withColumn(date_col, dates)
    else:
        spine = df.sparkSession.range(1).select(dates.alias(date_col))
    out = spine.join(df, on=[*key_cols, date_col], how="left")
    return out.fillna(fill) if fill else out


def align(series: Sequence[DataFrame], key) -> DataFrame:
    """Align several (key, value...) frames on ``key`` (a name or list of names) by
    chained full outer joins; join-by-name coalesces the key columns."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), series)


def assign_nearest(points: DataFrame, centroids: DataFrame, vec_cols: Sequence[str],
                   cluster_col: str = "cluster") -> DataFrame:
    """Nearest centroid per row (squared Euclidean; ties -> lower cluster id).

    The k centroids are folded into ONE value (an array bounded by k) read as a
    scalar subquery, and each point takes ``array_min`` over its k distances.
    Points are never shuffled and no pairs table is materialised."""
    cents = centroids.agg(F.collect_list(F.struct(
        F.col(cluster_col).alias("cid"),
        F.array(*[F.col(v).cast("double") for v in vec_cols]).alias("c")))).scalar()
    p = F.array(*[F.col(v).cast("double") for v in vec_cols])
    dist = lambda c: F.aggregate(
        F.zip_with(c["c"], p, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    best = F.array_min(F.transform(F.col("_cents"), lambda c: F.struct(dist(c).alias("d2"), c["cid"].alias("cid"))))
    return (points.withColumn("_cents", cents)
            .withColumn("_best", best)
            .withColumn(cluster_col, F.col("_best.cid"))
            .withColumn("dist2", F.col("_best.d2"))
            .drop("_cents", "_best"))
