"""Monthly revenue forecasting for many series at once.

Input is a long table ``(tenant, series, month, value, policy_count)``; the scale
axis is the number of series.  Everything expressible as SQL (monthly
preparation on a calendar spine, winsorising, Fourier terms, a centred moving
average decomposition, seasonal indices, log-linear trends, MAPE, comparison,
ensemble, YoY, model bands) is DataFrame code here; the fitted models are in
``series_models``.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.functions.exprs import safe_div

KEYS = ("tenant", "series")
PERIODS = (12, 6, 4, 3)


def month_index(c, origin: str = "1995-01-01") -> Column:
    """Months since ``origin`` (t = 0, 1, 2 ...)."""
    o = F.to_date(F.lit(origin))
    return ((F.year(c) - F.year(o)) * 12 + F.month(c) - F.month(o)).cast("int")


# ---------------------------------------------------------------------------
# preparation
# ---------------------------------------------------------------------------

def month_pivot(policies: DataFrame, renewal_flag: str = "Yes", new_flag: str = "No") -> DataFrame:
    """Policy rows -> per (tenant, month): new / renewal premium, fees, counts.
    Renewal NULL -> 0, new premium NULL stays NULL (as the source does)."""
    m = F.trunc("effective_date", "month")
    ren, new = F.col("is_renewal") == renewal_flag, F.col("is_renewal") == new_flag
    return policies.groupBy("tenant", m.alias("month")).agg(
        F.sum(F.when(new, F.col("written_premium"))).alias("new_premium"),
        F.coalesce(F.sum(F.when(ren, F.col("written_premium"))), F.lit(0.0)).alias("renewal_premium"),
        F.sum("fees").alias("fees"),
        F.count(F.when(new, F.col("policy_id"))).alias("new_pol"),
        F.count(F.when(ren, F.col("policy_id"))).alias("ren_pol"),
        F.count("policy_id").alias("tot_pol"))


def prepare(policies: DataFrame, start: str, end: str) -> DataFrame:
    """Monthly frame on a complete calendar [start, end) (partial months outside
    are removed); counts fill 0, values stay NULL; totals added."""
    piv = month_pivot(policies).filter((F.col("month") >= F.lit(start).cast("date")) & (F.col("month") < F.lit(end).cast("date")))
    last = F.add_months(F.to_date(F.lit(end)), -1)
    spine = piv.select("tenant").distinct().withColumn(
        "month", F.explode(F.sequence(F.to_date(F.lit(start)), last, F.expr("INTERVAL 1 MONTH"))))
    out = spine.join(piv, ["tenant", "month"], "left").fillna(0, subset=["new_pol", "ren_pol", "tot_pol"])
    return out.withColumns({
        "total_premium": F.col("new_premium") + F.col("renewal_premium"),
        "topline_revenue": F.col("new_premium") + F.col("renewal_premium") + F.col("fees")})


def to_long(monthly: DataFrame) -> DataFrame:
    """Wide monthly frame -> (tenant, series, month, value, policy_count)."""
    pairs = [("new_premium", "new_pol"), ("renewal_premium", "ren_pol"), ("fees", "tot_pol")]
    arr = F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).cast("double").alias("value"),
                             F.col(c).cast("double").alias("policy_count")) for s, c in pairs])
    return monthly.select("tenant", "month", F.explode(arr).alias("x")).select(
        "tenant", "x.series", "month", "x.value", "x.policy_count")


def winsorise(df: DataFrame, lo: float = 0.025, hi: float = 0.975, train_start: str | None = None,
              train_end: str | None = None, col: str = "value", by: Sequence[str] = KEYS) -> DataFrame:
    """Clip to per-series exact quantiles computed on the training window."""
    tr = df
    if train_start:
        tr = tr.filter(F.col("month") >= F.lit(train_start).cast("date"))
    if train_end:
        tr = tr.filter(F.col("month") < F.lit(train_end).cast("date"))
    q = tr.groupBy(*by).agg(F.percentile(col, F.lit(lo)).alias("_lo"), F.percentile(col, F.lit(hi)).alias("_hi"))
    return tr.join(q, list(by)).withColumn(f"{col}_w", F.least(F.greatest(F.col(col), F.col("_lo")), F.col("_hi"))) \
             .drop("_lo", "_hi")


def fourier(df: DataFrame, t: str = "t", periods: Sequence[int] = PERIODS) -> DataFrame:
    cols = {}
    for p in periods:
        cols[f"sin_{p}"] = F.sin(F.lit(2 * math.pi) * F.col(t) / F.lit(p))
        cols[f"cos_{p}"] = F.cos(F.lit(2 * math.pi) * F.col(t) / F.lit(p))
    return df.withColumns(cols)


def horizon_frame(df: DataFrame, horizon: int = 36, by: Sequence[str] = KEYS) -> DataFrame:
    """Future months after each series' last month (one row per series and step)."""
    last = df.groupBy(*by).agg(F.max("month").alias("_last"))
    return last.select(*by, F.posexplode(F.sequence(F.lit(1), F.lit(horizon))).alias("_i", "step")) \
               .join(last, list(by)).select(*by, "step", F.add_months("_last", F.col("step")).alias("month"))


def features(df: DataFrame, horizon: int = 36, spike_month: str | None = None, origin: str = "1995-01-01",
             by: Sequence[str] = KEYS) -> DataFrame:
    """History + horizon rows with Fourier terms, policy count / its mean (held at
    the last observed value over the horizon) and a one-month spike flag."""
    st = df.groupBy(*by).agg(F.avg("policy_count").alias("_pm"), F.max_by("policy_count", "month").alias("_pl"))
    hist = df.select(*by, "month", "value", "policy_count", F.lit(False).alias("is_future"))
    fut = horizon_frame(df, horizon, by).select(*by, "month", F.lit(None).cast("double").alias("value"),
                                                F.lit(None).cast("double").alias("policy_count"), F.lit(True).alias("is_future"))
    allr = hist.unionByName(fut).join(st, list(by))
    pol = F.when(F.col("is_future"), F.col("_pl")).otherwise(F.col("policy_count")) / (F.col("_pm") + F.lit(1e-8))
    spike = (F.col("month") == F.lit(spike_month).cast("date")) if spike_month else F.lit(False)
    out = allr.withColumn("t", month_index(F.col("month"), origin)).withColumn("policy_norm", pol) \
              .withColumn("spike", spike.cast("double")).drop("_pm", "_pl", "policy_count")
    return fourier(out)


# ---------------------------------------------------------------------------
# decomposition, seasonal index, trend
# ---------------------------------------------------------------------------

def decompose(df: DataFrame, m: int = 12, by: Sequence[str] = KEYS, col: str = "value", robust: int = 0) -> DataFrame:
    """Centred 2 x m moving average trend on log1p(value), seasonal = month means of
    the detrended series centred to sum 0, residual = the rest.

    With ``robust`` rounds the first seasonal means are medians, and then a month weighs (1 - (residual / s)^2)^2 with s six times the series' median absolute residual, 0
    beyond s and 1 where it has no residual; the trend is then the weighted moving average of the series without its season, the
    season the weighted month means.  All of it is window columns over one partitioning."""
    p, o = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("month")
    same_month = Window.partitionBy(*by, "moy")
    half = m // 2
    whole = F.count("y").over(o.rowsBetween(-half, half)) == m + 1

    def smooth(c):
        ends = F.lag(c, half).over(o) + F.lead(c, half).over(o)
        return F.sum(c).over(o.rowsBetween(-(half - 1), half - 1)) + F.lit(0.5) * ends

    def with_season(d, weight):
        """Weighted month means (without weights: medians) of y - trend, centred over the months that have one."""
        off = F.col("y") - F.col("trend")
        middle = F.percentile(off, F.lit(0.5)).over(same_month) if weight is None else \
            safe_div(F.sum(weight * off).over(same_month), F.sum(F.when(off.isNotNull(), weight)).over(same_month))
        d = d.withColumn("_s", middle)
        share = F.when(F.col("_s").isNotNull(), F.lit(1.0) / F.count(F.lit(1)).over(same_month))     # each month counts once
        d = d.withColumn("_one", share)
        d = d.withColumn("seasonal_index", F.col("_s") - F.sum(F.col("_s") * F.col("_one")).over(p) / F.sum("_one").over(p)).drop("_s", "_one")
        return d.withColumn("resid", F.col("y") - F.col("trend") - F.col("seasonal_index"))

    d = df.withColumns({"y": F.log1p(F.col(col)), "moy": F.month("month")})
    d = with_season(d.withColumn("trend", F.when(whole, smooth("y") / F.lit(m))), None if robust else F.lit(1.0))
    for _ in range(robust):
        d = d.withColumn("_a", F.abs("resid")).withColumn("_far", 6 * F.percentile("_a", F.lit(0.5)).over(p) + F.lit(1e-9))
        bisquare = F.pow(1 - F.pow(F.col("resid") / F.col("_far"), 2), 2)
        d = d.withColumn("_w", F.when(F.col("resid").isNull(), 1.0).when(F.col("_a") >= F.col("_far"), 0.0).otherwise(bisquare))
        d = d.withColumn("_wz", F.col("_w") * (F.col("y") - F.coalesce("seasonal_index", F.lit(0.0))))
        d = d.withColumn("trend", F.when(whole, safe_div(smooth("_wz"), smooth("_w"))))
        d = with_season(d, F.col("_w")).drop("_a", "_far", "_w", "_wz")
    return d


def seasonal_by_month(dec: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    return dec.select(*by, "moy", "seasonal_index").distinct()


def donor_season(dec: DataFrame, donors: Sequence[str], name: str = "donor", by: str = "tenant") -> DataFrame:
    """Average seasonal index of several donor series per calendar month."""
    s = seasonal_by_month(dec)
    return s.filter(F.col("series").isin(*donors)).groupBy(by, "moy").agg(F.avg("seasonal_index").alias(f"{name}_seasonal"))


def log_trend(df: DataFrame, start: str, cap: float | None = None, by: Sequence[str] = KEYS,
              origin: str = "1995-01-01") -> DataFrame:
    """Line through log1p(value) on months >= start: slope, intercept, CAGR.  With
    ``cap`` the slope is limited and the line re-anchored at the last point."""
    d = df.filter((F.col("month") >= F.lit(start).cast("date")) & F.col("value").isNotNull()) \
          .withColumn("t", month_index(F.col("month"), origin)).withColumn("y", F.log1p("value"))
    fit = d.groupBy(*by).agg(F.regr_slope("y", "t").alias("slope0"), F.regr_intercept("y", "t").alias("intercept0"),
                            F.max_by("y", "t").alias("_yl"), F.max("t").alias("_tl"))
    if cap is None:
        slope, icpt = F.col("slope0"), F.col("intercept0")
    else:
        over = F.col("slope0") > F.lit(cap)
        slope = F.when(over, F.lit(cap)).otherwise(F.col("slope0"))
        icpt = F.when(over, F.col("_yl") - F.lit(cap) * F.col("_tl")).otherwise(F.col("intercept0"))
    return fit.select(*by, slope.alias("slope"), icpt.alias("intercept"), (F.exp(F.col("slope0") * 12) - 1).alias("cagr"))


# ---------------------------------------------------------------------------
# SQL-expressible forecasters (also the inputs of compare / ensemble / yoy)
# ---------------------------------------------------------------------------

def fc_seasonal_naive(df: DataFrame, horizon: int = 36, m: int = 12, by: Sequence[str] = KEYS) -> DataFrame:
    """Repeat the last m observed values: step s takes the value of the last
    season at position (s - 1) mod m."""
    w = Window.partitionBy(*by).orderBy(F.col("month").desc())
    last = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= m) \
             .withColumn("pos", F.lit(m) - F.col("_r")).select(*by, "pos", F.col("value").alias("forecast"))
    h = horizon_frame(df, horizon, by).withColumn("pos", F.pmod(F.col("step") - 1, F.lit(m)))
    return h.join(last, [*by, "pos"], "left").select(*by, "month", F.lit("seasonal_naive").alias("model"), "forecast")


def fc_log_trend(df: DataFrame, start: str, horizon: int = 36, cap: float | None = None, by: Sequence[str] = KEYS,
                 origin: str = "1995-01-01") -> DataFrame:
    tr = log_trend(df, start, cap, by, origin)
    h = horizon_frame(df, horizon, by).join(tr, list(by))
    return h.select(*by, "month", F.lit("log_trend").alias("model"),
                    F.expm1(F.col("intercept") + F.col("slope") * month_index(F.col("month"), origin)).alias("forecast"))


def fc_trend_season(df: DataFrame, start: str, horizon: int = 36, cap: float | None = None, by: Sequence[str] = KEYS,
                    origin: str = "1995-01-01") -> DataFrame:
    tr = log_trend(df, start, cap, by, origin)
    s = seasonal_by_month(decompose(df, by=by))
    h = horizon_frame(df, horizon, by).join(tr, list(by)).withColumn("moy", F.month("month")).join(s, [*by, "moy"], "left")
    yhat = F.col("intercept") + F.col("slope") * month_index(F.col("month"), origin) + F.coalesce(F.col("seasonal_index"), F.lit(0.0))
    return h.select(*by, "month", F.lit("trend_season").alias("model"), F.expm1(yhat).alias("forecast"))


def mape(actual: DataFrame, forecast: DataFrame, n: int = 12, by: Sequence[str] = KEYS) -> DataFrame:
    """mean(|a - f| / max(a, 1)) * 100 over the last n actual months, per model."""
    w = Window.partitionBy(*by).orderBy(F.col("month").desc())
    last = actual.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select(*by, "month", "value")
    j = last.join(forecast, [*by, "month"])
    return j.groupBy(*by, "model").agg(
        (F.avg(F.abs(F.col("value") - F.col("forecast")) / F.greatest(F.col("value"), F.lit(1.0))) * 100).alias("mape"))


def compare(forecasts: DataFrame, models: Sequence[str], by: Sequence[str] = KEYS) -> DataFrame:
    """Models side by side on their common months, summed per calendar year."""
    wide = forecasts.groupBy(*by, "month").pivot("model", list(models)).agg(F.first("forecast"))
    common = wide.dropna(subset=list(models))
    return common.groupBy(*by, F.year("month").alias("year")).agg(*[F.sum(m).alias(m) for m in models])


def ensemble(forecasts: DataFrame, weights: DataFrame | None = None, by: Sequence[str] = KEYS) -> DataFrame:
    """Weighted mean across models per (series, month); equal weights by default.
    ``weights``: (series..., model, weight), e.g. inverse MAPE."""
    f = forecasts
    if weights is None:
        n = F.count("model").over(Window.partitionBy(*by, "month"))
        f = f.withColumn("weight", F.lit(1.0) / n)
    else:
        f = f.join(weights, [*by, "model"])
    return f.groupBy(*by, "month").agg((F.sum(F.col("weight") * F.col("forecast")) / F.sum("weight")).alias("forecast"))


def totals(ens: DataFrame) -> DataFrame:
    """Per tenant-month: series plus total premium and topline."""
    w = ens.groupBy("tenant", "month").pivot("series", ["new_premium", "renewal_premium", "fees"]).agg(F.first("forecast"))
    return w.withColumns({"total_premium": F.col("new_premium") + F.col("renewal_premium"),
                          "topline_revenue": F.col("new_premium") + F.col("renewal_premium") + F.col("fees")})


def yoy(forecast: DataFrame, actual: DataFrame, base_year: int, by: Sequence[str] = ("tenant",)) -> DataFrame:
    """Annual topline per year (actual months where present, forecast otherwise —
    a blended year = actual H1 + forecast H2) against the base-year actual."""
    a = actual.select(*by, "month", F.col("value").alias("a"))
    f = forecast.select(*by, "month", F.col("forecast").alias("f"))
    j = a.join(f, [*by, "month"], "full_outer").withColumn("v", F.coalesce("a", "f"))
    yr = j.groupBy(*by, F.year("month").alias("year")).agg(F.sum("v").alias("topline"),
                                                           F.count("a").alias("actual_months"))
    base = yr.filter(F.col("year") == base_year).select(*by, F.col("topline").alias("_base"))
    return yr.join(base, list(by), "left").withColumn("yoy", safe_div(F.col("topline"), F.col("_base")) - 1).drop("_base")


def band(forecasts: DataFrame, models: Sequence[str], by: Sequence[str] = KEYS) -> DataFrame:
    wide = forecasts.groupBy(*by, "month").pivot("model", list(models)).agg(F.first("forecast"))
    return wide.select(*by, "month", *models, F.least(*[F.col(m) for m in models]).alias("low"),
                       F.greatest(*[F.col(m) for m in models]).alias("high"))
