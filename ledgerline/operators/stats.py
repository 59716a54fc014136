"""Exact statistics: quantiles, describe, histograms and kernel density.

Quantiles are exact with linear interpolation (same as DuckDB ``quantile_cont`` and
pandas' default); ``percentile_approx`` only brackets the ranks.  Global
statistics (min/max/sd for bin edges, bandwidths) are one-row aggregates read
as scalar subqueries: no cross join, nothing collected to the driver."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F


LEFT = 100_000         # rows that may be left for the last, single-task step of a quantile
PARTS = 256            # ranges a narrowing round cuts a bracket into


def size_bound(df: DataFrame) -> int:
    """Catalyst's bytes of a frame's sources (files, ranges; unknown ones count as 0); nothing is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def _attach(x: DataFrame, st: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with their group's count and brackets."""
    if by:
        return x.join(st, list(by))
    return x.withColumn("_st", st.select(F.struct("_n", "_lo", "_hi").alias("s")).scalar()).select("_x", "_st._n", "_st._lo", "_st._hi")


def _inside(xj: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """(by..., i, _x): rows in the bracket of target i, once for each bracket they fall in."""
    idx = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.col("_x") >= F.element_at("_lo", i + 1)) & (F.col("_x") <= F.element_at("_hi", i + 1)))
    return xj.select(*by, "_x", F.explode(idx).alias("i"))


def _narrowed(x: DataFrame, st: DataFrame, ps: Sequence[float], by: Sequence[str], accuracy: int) -> DataFrame:
    """Brackets about ``PARTS`` times smaller: the rows of each are counted by ranges between their own approximate
    quantiles, and the ranges that hold the target's two ranks are kept.  Ranges follow the values' ranks, so any distribution narrows alike."""
    xj = _attach(x, st, by)
    inside = _inside(xj, by, len(ps))
    below = xj.groupBy(*by).agg(F.max("_n").alias("_n"), F.array(*[F.struct(F.lit(p).alias("p"), F.count(F.when(F.col("_x") < F.col("_lo")[i], 1)).alias("below"))
                                                                  for i, p in enumerate(ps)]).alias("t"))
    below = below.select(*by, "_n", F.posexplode("t").alias("i", "t")).select(*by, "_n", "i", "t.*")
    cuts = inside.groupBy(*by, "i").agg(F.percentile_approx("_x", F.array(*[F.lit(j / PARTS) for j in range(1, PARTS)]), accuracy).alias("_cuts"))
    place = F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
    part = inside.join(cuts, [*by, "i"]).groupBy(*by, "i", place.alias("_s")).agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    w = Window.partitionBy(*by, "i").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)             # PARTS rows a target
    part = part.withColumn("_upto", F.sum("_c").over(w)).join(below, [*by, "i"])
    r0 = F.floor(F.col("p") * (F.col("_n") - 1))
    new = part.groupBy(*by, "i").agg(
        F.max("_n").alias("_n"),
        F.coalesce(F.min(F.when(F.col("below") + F.col("_upto") - 1 >= r0, F.col("_a"))), F.max("_b")).alias("lo"),
        F.coalesce(F.max(F.when(F.col("below") + F.col("_upto") - F.col("_c") <= r0 + 1, F.col("_b"))), F.min("_a")).alias("hi"))
    rows = F.sort_array(F.collect_list(F.struct("i", "lo", "hi")))
    return new.groupBy(*by).agg(F.max("_n").alias("_n"), rows.alias("t")).select(
        *by, "_n", F.transform("t", lambda r: r["lo"]).alias("_lo"), F.transform("t", lambda r: r["hi"]).alias("_hi"))


def exact_quantiles(df: DataFrame, c: str, ps: Sequence[float], by: Sequence[str] = (),
                    accuracy: int = 10000, rounds: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (same as ``percentile`` / ``quantile_cont``)
    without gathering a group's values in one task; one path for groups of every size.

    Pass 1: per group, the row count and ``percentile_approx`` brackets around each target
    rank (about 4n / accuracy rows).  Then ``rounds`` narrowing rounds, each of which leaves about one row in 256; as many as bring the
    rows inside a bracket under ``LEFT`` by the size of the frame's sources: none for small frames, two (6,000 rows of 1e12 left) at most.  Last pass: the rows below each bracket, its neighbours (largest value below it,
    smallest above it) and the rows inside it, aggregated by value, with a running count over
    those few values.  The two order statistics of a target
    are picked among them; a target outside its bracket and neighbours raises an error.
    Output: (by..., i, p, q) with i the index into ``ps``."""
    ps = [float(p) for p in ps]
    eps = 2.0 / accuracy
    x = df.select(*by, F.col(c).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    if rounds is None:
        rounds = min(2, math.ceil(math.log(max(size_bound(x) * 2 * eps / LEFT, 1)) / math.log(PARTS)))
    lo_ps = [max(p - eps, 0.0) for p in ps]
    hi_ps = [min(p + eps, 1.0) for p in ps]
    st = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"),
                            F.percentile_approx("_x", F.array(*map(F.lit, lo_ps)), accuracy).alias("_lo"),
                            F.percentile_approx("_x", F.array(*map(F.lit, hi_ps)), accuracy).alias("_hi"))
    for _ in range(rounds):
        st = _narrowed(x, st, ps, by, accuracy)
    xj = _attach(x, st, by)
    aggs = []
    for i in range(len(ps)):
        under, over = F.col("_x") < F.col("_lo")[i], F.col("_x") > F.col("_hi")[i]
        aggs += [F.struct(F.lit(ps[i]).alias("p"), F.count(F.when(under, 1)).alias("below"), F.count(F.when(over, 1)).alias("above"),
                          F.max(F.when(under, F.col("_x"))).alias("prev"), F.min(F.when(over, F.col("_x"))).alias("next")).alias(f"_t{i}")]
    targets = xj.groupBy(*by).agg(F.max("_n").alias("_n"), *aggs).select(
        *by, "_n", F.posexplode(F.array(*[F.col(f"_t{i}") for i in range(len(ps))])).alias("i", "t")).filter(F.col("_n") > 0)
    # rows inside any bracket, combined by value
    inside = _inside(xj, by, len(ps)).groupBy(*by, "i", "_x").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by, "i").orderBy("_x")
    inside = inside.withColumn("_cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    targets = targets.select(*by, "i", "_n", "t.*", (F.col("t.p") * (F.col("_n") - 1)).alias("_h"))
    j = inside.join(targets, [*by, "i"])
    last_rank = F.col("below") + F.col("_cum") - 1               # 0-based rank of the last copy of a value
    r0 = F.floor("_h")

    def at(rank, name):
        return F.min(F.when(last_rank >= rank, F.col("_x"))).alias(name)

    pick = j.groupBy(*by, "i", "p", "_h", "_n", "below", "above", "prev", "next").agg(at(r0, "_v0"), at(r0 + 1, "_v1"))
    top = F.col("_n") - F.col("above")                           # first rank above the bracket

    def value(rank, inner):
        found = F.when(rank == F.col("below") - 1, F.col("prev")).when(rank == top, F.col("next")) \
                 .when((rank >= F.col("below")) & (rank < top), inner)
        return F.coalesce(found, F.raise_error(F.lit("quantile rank outside its bracket")).cast("double"))

    frac = F.col("_h") - r0
    v0 = value(r0, F.col("_v0"))
    q = F.when(frac == 0, v0).otherwise(v0 + (value(r0 + 1, F.col("_v1")) - v0) * frac)
    return pick.select(*by, "i", "p", q.alias("q"))


def quantile(df: DataFrame, c: str, p: float, by: Sequence[str] = (), out: str = "q") -> DataFrame:
    """Exact quantile (linear interpolation) per group, two-pass so no group is gathered."""
    return exact_quantiles(df, c, [p], by).select(*by, F.col("q").alias(out))


def quantile_grid(df: DataFrame, c: str, step: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Quantiles at 0, step, ..., 1 as long rows (p, q)."""
    n = int(round(1 / step))
    ps = [round(i * step, 10) for i in range(n + 1)]
    return exact_quantiles(df, c, ps, by).select(*by, F.round(F.col("i") * F.lit(step), 10).alias("p"), "q")


def describe_exact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75%, max per column as long rows.
    One scan: columns are stacked to (measure, value) and grouped by column."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x"))
                                            for c in cols])).alias("s")).select("s.measure", "s.x")
    moments = stacked.groupBy("measure").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    qs = exact_quantiles(stacked, "x", [0.25, 0.5, 0.75], ["measure"]) \
        .groupBy("measure").pivot("i", [0, 1, 2]).agg(F.first("q")) \
        .select("measure", F.col("0").alias("p25"), F.col("1").alias("p50"), F.col("2").alias("p75"))
    return moments.join(qs, "measure", "left").select("measure", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def histogram(df: DataFrame, c: str, bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max] (a constant column uses [v-0.5, v+0.5]);
    the maximum falls in the last bin.  Output: (by..., bin, lo, hi, count, mean)
    where ``mean`` is the mean of the histogrammed data (the overlay line)."""
    x = F.col(c).cast("double")
    base = df.select(*by, x.alias("_x")).filter(F.col("_x").isNotNull())
    stats = base.groupBy(*by).agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"), F.avg("_x").alias("mean"))
    stats = stats.select(*by, F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                         F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"),
                         "mean")
    if by:
        j = base.join(stats, list(by))
    else:
        s = stats.select(F.struct("_lo", "_hi", "mean").alias("s")).scalar()
        j = base.withColumn("_st", s).select("_x", F.col("_st._lo").alias("_lo"), F.col("_st._hi").alias("_hi"),
                                             F.col("_st.mean").alias("mean"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    b = F.least(F.floor((F.col("_x") - F.col("_lo")) / width).cast("int"), F.lit(bins - 1))
    counted = j.withColumn("bin", b).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"))
    # every bin of every group, also the empty ones
    spine = stats.filter(F.col("_lo").isNotNull()).select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    return spine.join(counted, [*by, "bin"], "left").select(
        *by, "bin", (F.col("_lo") + F.col("bin") * w).alias("lo"), (F.col("_lo") + (F.col("bin") + 1) * w).alias("hi"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"), "mean")


def kde(df: DataFrame, c: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on ``grid`` points over [min - cut*h, max + cut*h],
    Scott bandwidth h = sd * n^(-1/5): the exact sum over all values, none binned.  Equal values are
    combined to (value, count) first, so the work is (#distinct values) x grid: each value fans out to the
    ``grid`` points through ``sequence`` (no join), and the points' sums are combined before the shuffle."""
    x = df.select(F.col(c).cast("double").alias("v")).filter(F.col("v").isNotNull())
    vals = x.groupBy("v").agg(F.count(F.lit(1)).alias("cnt"))
    st = x.agg(F.count("v").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("mn"), F.max("v").alias("mx"))
    h = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    lo = F.col("mn") - F.lit(cut) * h
    step = (F.col("mx") + F.lit(cut) * h - lo) / F.lit(grid - 1)
    st = st.select(F.struct("n", h.alias("h"), lo.alias("lo"), step.alias("step")).alias("s")).scalar()
    pts = vals.withColumn("_st", st).select("_st", "v", "cnt", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    xg = F.col("_st.lo") + F.col("i") * F.col("_st.step")
    u = (xg - F.col("v")) / F.col("_st.h")
    norm = F.lit(1.0 / math.sqrt(2 * math.pi)) / (F.col("_st.n") * F.col("_st.h"))
    return pts.groupBy("i", "_st").agg(F.sum(F.col("cnt") * F.exp(-0.5 * u * u)).alias("_s")).select(
        F.col("i").alias("point"), xg.alias("x"), (F.col("_s") * norm).alias("density"))
