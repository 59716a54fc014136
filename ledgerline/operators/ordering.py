"""Sort, top-k, sampling and de-duplication.  A limit appears only where it is the
feature (top-n movers, the first n records of a report, an exact-n sample);
``orderBy(...).limit(n)`` plans as TakeOrderedAndProject (per-partition top-n,
then a merge of n rows per partition: no full sort, no full shuffle)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.operators.stats import size_bound



def newest_first(df: DataFrame, c: str, *tiebreak: str) -> DataFrame:
    return df.orderBy(F.col(c).desc_nulls_last(), *[F.col(t).asc_nulls_first() for t in tiebreak])


def top_movers(df: DataFrame, metric: str, n: int, keys: Sequence[str], ascending: bool = False) -> DataFrame:
    m = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return df.orderBy(m, *[F.col(k).asc_nulls_first() for k in keys]).limit(n)


def decliners(df: DataFrame, n: int, keys: Sequence[str], delta: str = "delta", from_top: int | None = None) -> DataFrame:
    """Rows with a negative change, most negative first.  ``from_top`` reproduces the
    source behaviour of picking decliners only among the top gainers."""
    src = top_movers(df, delta, from_top, keys) if from_top else df
    return src.filter(F.col(delta) < 0).orderBy(F.col(delta).asc(), *[F.col(k).asc_nulls_first() for k in keys]).limit(n)


def top1(df: DataFrame, by: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """Best row per group by ``order`` (ties -> the largest field tuple, identical in SQL via max(struct)), via one aggregate."""
    best = F.max(F.struct(F.col(order).alias("_o"), *[F.col(f) for f in fields]))
    agg = df.groupBy(*by).agg(best.alias("_b")) if by else df.agg(best.alias("_b"))
    return agg.select(*by, *[F.col(f"_b.{f}").alias(f) for f in fields])


def head_records(df: DataFrame, order: Sequence[Column], n: int = 8) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42, rounds: int | None = None) -> DataFrame:
    """Exact-n sample without replacement, deterministic under repartitioning: the ``n`` rows with the smallest md5(key || seed).

    Rows are counted by the first four hex digits of their hash and, where the frame's estimated size asks for a second of the ``rounds``, those of
    the range that holds the n-th by the next four.  Only rows up to the last range's end, about ``n``, leave the scan to be
    ordered (ties of the hash by key)."""
    if n <= 0:
        return df.limit(0)
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    rows = df.withColumn("_h", F.coalesce(h, F.lit("f" * 32)))          # a null key comes last
    if rounds is None:
        rounds = 1 if size_bound(df) / n < 1 << 16 else 2
    hashes, top = rows.select("_h"), None
    for r in range(1, rounds + 1):
        # counts of ranges, smaller ones inside those found before; the range that holds the n-th row is the new top
        digits = F.col("_h") if top is None else F.when(F.substring("_h", 1, 4 * r - 4) == F.col("_top"), F.substring("_h", 1, 4 * r)).otherwise(F.substring("_h", 1, 4 * r - 4))
        part = hashes if top is None else hashes.withColumn("_top", top).filter(F.substring("_h", 1, 4 * r - 4) <= F.col("_top"))
        counts = part.groupBy((F.substring("_h", 1, 4) if top is None else digits).alias("p")).agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))      # 65,536 rows at most, and n
        found = counts.withColumn("upto", upto).agg(F.coalesce(F.min(F.when(F.col("upto") >= n, F.col("p"))), F.max("p")).alias("t"))
        top = found.select("t").scalar()
    kept = rows.withColumn("_top", top).filter(F.substring(F.col("_h"), F.lit(1), F.length("_top")) <= F.col("_top"))
    return kept.orderBy("_h", key).limit(n).drop("_h", "_top")


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per key in an explicit order (``dropDuplicates`` keeps an
    arbitrary one)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def reorder(df: DataFrame, label_col: str, order: Sequence[str], pos_col: str = "pos") -> DataFrame:
    """Fixed category order: listed labels only (unlisted rows dropped); a listed
    label absent from the data appears with NULL measures."""
    spark = df.sparkSession
    spine = spark.createDataFrame([(lab, i) for i, lab in enumerate(order)], f"{label_col} string, {pos_col} int")
    return F.broadcast(spine).join(df, label_col, "left").orderBy(pos_col)    # len(order) rows
