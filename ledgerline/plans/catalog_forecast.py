"""Registered forecasting queries (Spark) and their DuckDB oracles."""

from __future__ import annotations

import math
import os
import uuid
from functools import reduce

from pyspark.ml.regression import LinearRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window, functions as F

from ledgerline.functions.exprs import clip, safe_div
from ledgerline.operators.aggregates import by_year, grand_total, model_range
from ledgerline.operators.joins import align
from ledgerline.operators.reshape import melt
from ledgerline.operators.windows import difference, first_last_value, lag_features, sequence_index, split_holdout
from ledgerline.plans import bindings as B
from ledgerline.plans import forecast as FC, series_models as SM
from ledgerline.plans.registry import register
from ledgerline.session import checkpoint_dir, cut_lineage
from ledgerline.sources.sinks import write_csv
from ledgerline.sources.tables import read_policies

START, END = "1995-01-01", "2001-08-01"      # partial months outside are removed
TREND_START = "1998-01-01"
FEE_CAP = math.log(1.5) / 12
BASE_YEAR = 2000
SPIKE = "2001-05-01"
MODELS = ["seasonal_naive", "log_trend", "trend_season"]
def t_sql(c: str = "month") -> str:
    return f"CAST((year({c}) - 1995) * 12 + month({c}) - 1 AS INTEGER)"


T_SQL = t_sql()


def policies(spark, d):
    return B.binding(spark, d, "policies")


def monthly(spark, d):
    return FC.prepare(policies(spark, d), START, END)


def long(spark, d):
    return FC.to_long(monthly(spark, d))


def kept(spark, d):
    """The monthly series of every tenant, read once and written to the checkpoint folder: a few hundred rows a tenant, which the models
    pass over many times."""
    return cut_lineage(long(spark, d))


def sql_forecasts(lg):
    return (FC.fc_seasonal_naive(lg)
            .unionByName(FC.fc_log_trend(lg, TREND_START))
            .unionByName(FC.fc_trend_season(lg, TREND_START)))


# ------------------------------------------------------------------ oracle CTEs
CTE = {
    "pv": """SELECT tenant, CAST(date_trunc('month', effective_date) AS DATE) AS month,
        sum(CASE WHEN is_renewal = 'No' THEN written_premium END) AS new_premium,
        coalesce(sum(CASE WHEN is_renewal = 'Yes' THEN written_premium END), 0) AS renewal_premium,
        sum(fees) AS fees, count(CASE WHEN is_renewal = 'No' THEN policy_id END) AS new_pol,
        count(CASE WHEN is_renewal = 'Yes' THEN policy_id END) AS ren_pol, count(policy_id) AS tot_pol
        FROM policies GROUP BY 1, 2""",
    "pvw": f"SELECT * FROM pv WHERE month >= DATE '{START}' AND month < DATE '{END}'",
    "spine": f"""SELECT t.tenant, CAST(g.m AS DATE) AS month FROM (SELECT DISTINCT tenant FROM pvw) AS t,
        generate_series(DATE '{START}', DATE '{END}' - INTERVAL 1 MONTH, INTERVAL 1 MONTH) AS g(m)""",
    "monthly": """SELECT s.tenant, s.month, p.new_premium, p.renewal_premium, p.fees,
        coalesce(p.new_pol, 0) AS new_pol, coalesce(p.ren_pol, 0) AS ren_pol, coalesce(p.tot_pol, 0) AS tot_pol,
        p.new_premium + p.renewal_premium AS total_premium, p.new_premium + p.renewal_premium + p.fees AS topline_revenue
        FROM spine s LEFT JOIN pvw p ON s.tenant = p.tenant AND s.month = p.month""",
    "long": """SELECT tenant, 'new_premium' AS series, month, CAST(new_premium AS DOUBLE) AS value, CAST(new_pol AS DOUBLE) AS policy_count FROM monthly
        UNION ALL SELECT tenant, 'renewal_premium', month, CAST(renewal_premium AS DOUBLE), CAST(ren_pol AS DOUBLE) FROM monthly
        UNION ALL SELECT tenant, 'fees', month, CAST(fees AS DOUBLE), CAST(tot_pol AS DOUBLE) FROM monthly""",
    "hz": """SELECT l.tenant, l.series, r.s AS step, CAST(l.last + to_months(CAST(r.s AS INTEGER)) AS DATE) AS month
        FROM (SELECT tenant, series, max(month) AS last FROM long GROUP BY 1, 2) AS l, range(1, 37) AS r(s)""",
    "dec0": f"""SELECT *, ln(1 + value) AS y, month(month) AS moy FROM long""",
    "dec1": """SELECT *, CASE WHEN count(y) OVER (PARTITION BY tenant, series ORDER BY month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13
        THEN (sum(y) OVER (PARTITION BY tenant, series ORDER BY month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
              + 0.5 * (lag(y, 6) OVER (PARTITION BY tenant, series ORDER BY month) + lead(y, 6) OVER (PARTITION BY tenant, series ORDER BY month))) / 12
        END AS trend FROM dec0""",
    "sidx": """SELECT tenant, series, moy, avg(y - trend) - avg(avg(y - trend)) OVER (PARTITION BY tenant, series) AS seasonal_index
        FROM dec1 GROUP BY tenant, series, moy""",
    "trend": f"""SELECT tenant, series, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, exp(regr_slope(y, t) * 12) - 1 AS cagr
        FROM (SELECT tenant, series, {T_SQL} AS t, ln(1 + value) AS y FROM long WHERE month >= DATE '{TREND_START}' AND value IS NOT NULL) AS x
        GROUP BY 1, 2""",
    "f_naive": """SELECT h.tenant, h.series, h.month, 'seasonal_naive' AS model, l.value AS forecast FROM hz h
        LEFT JOIN (SELECT tenant, series, value, 12 - row_number() OVER (PARTITION BY tenant, series ORDER BY month DESC) AS pos FROM long) AS l
        ON h.tenant = l.tenant AND h.series = l.series AND l.pos = (h.step - 1) % 12 AND l.pos >= 0""",
    "f_trend": f"""SELECT h.tenant, h.series, h.month, 'log_trend' AS model, exp(tr.intercept + tr.slope * {t_sql('h.month')}) - 1 AS forecast
        FROM hz h JOIN trend tr ON h.tenant = tr.tenant AND h.series = tr.series""",
    "f_ts": f"""SELECT h.tenant, h.series, h.month, 'trend_season' AS model,
        exp(tr.intercept + tr.slope * {t_sql('h.month')} + coalesce(s.seasonal_index, 0)) - 1 AS forecast
        FROM hz h JOIN trend tr ON h.tenant = tr.tenant AND h.series = tr.series
        LEFT JOIN sidx s ON h.tenant = s.tenant AND h.series = s.series AND s.moy = month(h.month)""",
}
CTE["fc"] = "SELECT * FROM f_naive UNION ALL SELECT * FROM f_trend UNION ALL SELECT * FROM f_ts"
CTE["wide"] = "SELECT tenant, series, month, " + ", ".join(
    f"max(CASE WHEN model = '{m}' THEN forecast END) AS {m}" for m in MODELS) + " FROM fc GROUP BY 1, 2, 3"
CTE["ens"] = "SELECT tenant, series, month, avg(forecast) AS forecast FROM fc GROUP BY 1, 2, 3"
PREP = ["pv", "pvw", "spine", "monthly", "long"]
FCS = PREP + ["hz", "dec0", "dec1", "sidx", "trend", "f_naive", "f_trend", "f_ts", "fc"]


def ow(*ctes):
    return B.oracle_with(["policies"], {k: CTE[k] for k in ctes})


# ------------------------------------------------------------------ preparation
@register("agg_month_pivot", sql=ow("pv") + "SELECT * FROM pv", dbl=["new_premium", "renewal_premium", "fees"], dates=("month",))
def q_pivot(spark, d):
    """Policy rows -> monthly new / renewal / fees / counts per tenant."""
    return FC.month_pivot(policies(spark, d))


MONTHLY_DBL = ["new_premium", "renewal_premium", "fees", "total_premium", "topline_revenue"]


@register("fc_prepare", sql=ow(*PREP[:4]) + "SELECT * FROM monthly", dbl=MONTHLY_DBL, dates=("month",))
def q_prepare(spark, d):
    """Monthly series, partial months removed, calendar-complete (counts 0, values NULL)."""
    return monthly(spark, d)


@register("join_calendar_spine", sql=ow(*PREP[:4]) + "SELECT * FROM monthly", dbl=MONTHLY_DBL, dates=("month",))
def q_spine(spark, d):
    return monthly(spark, d)


@register("join_align_months", sql=ow("pv") + """SELECT coalesce(n.tenant, r.tenant, f.tenant) AS tenant, coalesce(n.month, r.month, f.month) AS month,
    n.new_premium, r.renewal_premium, f.fees FROM
    (SELECT tenant, month, new_premium FROM pv WHERE new_premium IS NOT NULL) AS n
    FULL OUTER JOIN (SELECT tenant, month, renewal_premium FROM pv) AS r ON n.tenant = r.tenant AND n.month = r.month
    FULL OUTER JOIN (SELECT tenant, month, fees FROM pv) AS f ON coalesce(n.tenant, r.tenant) = f.tenant AND coalesce(n.month, r.month) = f.month""",
          dbl=["new_premium", "renewal_premium", "fees"], dates=("month",))
def q_align(spark, d):
    """Separate monthly series aligned on (tenant, month) by full outer joins."""
    pv = FC.month_pivot(policies(spark, d))
    n = pv.filter(F.col("new_premium").isNotNull()).select("tenant", "month", "new_premium")
    r = pv.select("tenant", "month", "renewal_premium")
    f = pv.select("tenant", "month", "fees")
    return align([n, r, f], ["tenant", "month"])


@register("scan_flat_file", sql=ow() + "SELECT * FROM policies", dbl=["written_premium", "fees"], dates=("effective_date",))
def q_flat_file(spark, d):
    """Policy rows exported as CSV and re-read with a declared schema and a parsed date."""
    out = os.path.join(checkpoint_dir(spark), "policies_csv", uuid.uuid4().hex)
    write_csv(policies(spark, d), out)
    return read_policies(spark, out, fmt="csv", date_col="effective_date",
                        schema="tenant string, effective_date string, is_renewal string, written_premium double, fees double, policy_id long")


@register("scan_saved_result", sql=ow(*PREP[:4]) + "SELECT * FROM monthly", dbl=["new_premium", "renewal_premium", "fees", "total_premium", "topline_revenue"], dates=("month",))
def q_saved(spark, d):
    """Reopen the stored output of an earlier job (the monthly frame written as Parquet)."""
    from ledgerline.sources.tables import read_result
    out = os.path.join(checkpoint_dir(spark), "monthly", uuid.uuid4().hex)
    monthly(spark, d).write.mode("overwrite").parquet(out)
    return read_result(spark, out)


@register("sink_replace_table", sql=ow(*PREP[:4]) + "SELECT * FROM monthly", dbl=["new_premium", "renewal_premium", "fees", "total_premium", "topline_revenue"], dates=("month",))
def q_replace(spark, d):
    """Create-or-replace target: written twice, the second replaces the first."""
    from ledgerline.sources.sinks import replace_table
    out = os.path.join(checkpoint_dir(spark), "replace", uuid.uuid4().hex)
    m = monthly(spark, d)
    replace_table(m, out)
    replace_table(m, out)
    return spark.read.parquet(out)


@register("fc_winsorise", sql=ow(*PREP) + """SELECT l.*, least(greatest(l.value, q.lo), q.hi) AS value_w FROM long l JOIN
    (SELECT tenant, series, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM long
     WHERE month >= DATE '1996-01-01' GROUP BY 1, 2) AS q ON l.tenant = q.tenant AND l.series = q.series
    WHERE l.month >= DATE '1996-01-01'""", dbl=["value", "policy_count", "value_w"], dates=("month",))
def q_winsorise(spark, d):
    """Clip each series to its 2.5% / 97.5% quantiles on the training window."""
    return FC.winsorise(long(spark, d), 0.025, 0.975, train_start="1996-01-01")


FOURIER_SQL = ", ".join(f"sin(2 * pi() * t / {p}) AS sin_{p}, cos(2 * pi() * t / {p}) AS cos_{p}" for p in FC.PERIODS)


@register("fc_fourier", sql=ow(*PREP) + f"SELECT tenant, series, month, t, {FOURIER_SQL} FROM (SELECT *, {T_SQL} AS t FROM long) AS x",
          dbl=[f"{f}_{p}" for p in FC.PERIODS for f in ("sin", "cos")], dates=("month",))
def q_fourier(spark, d):
    """sin/cos at periods 12, 6, 4, 3 of the month index."""
    lg = long(spark, d).withColumn("t", FC.month_index(F.col("month")))
    return FC.fourier(lg).select("tenant", "series", "month", "t", *[f"{f}_{p}" for p in FC.PERIODS for f in ("sin", "cos")])


FEAT_SQL = f"""SELECT a.tenant, a.series, a.month, a.value, a.is_future, {t_sql('a.month')} AS t,
    CASE WHEN a.is_future THEN st.pl ELSE a.policy_count END / (st.pm + 1e-8) AS policy_norm,
    CAST(a.month = DATE '{SPIKE}' AS DOUBLE) AS spike
  FROM (SELECT tenant, series, month, value, policy_count, false AS is_future FROM long
        UNION ALL SELECT tenant, series, month, NULL, NULL, true FROM hz) AS a
  JOIN (SELECT tenant, series, avg(policy_count) AS pm, arg_max(policy_count, month) AS pl FROM long GROUP BY 1, 2) AS st
    ON a.tenant = st.tenant AND a.series = st.series"""


@register("fc_features", sql=ow(*PREP, "hz") + f"SELECT *, {FOURIER_SQL} FROM ({FEAT_SQL}) AS f",
          dbl=["value", "policy_norm", "spike"] + [f"{f}_{p}" for p in FC.PERIODS for f in ("sin", "cos")], dates=("month",))
def q_features(spark, d):
    """History + 36 future months: Fourier terms, normalised policy count held at
    its last value, one-month spike flag."""
    return FC.features(long(spark, d), 36, SPIKE)


OVER_MA = "OVER (PARTITION BY tenant, series ORDER BY month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
OVER_T = "OVER (PARTITION BY tenant, series ORDER BY month)"
ROUNDS = 2


def robust_ctes(rounds: int = ROUNDS) -> dict[str, str]:
    """The decomposition and its rounds of weights, a table a step."""
    smooth = lambda c: f"(sum({c}) {OVER_MA} + 0.5 * (lag({c}, 6) {OVER_T} + lead({c}, 6) {OVER_T}))"
    out = {"rs0": """SELECT tenant, series, moy, s - avg(s) OVER (PARTITION BY tenant, series) AS seasonal_index
        FROM (SELECT tenant, series, moy, median(y - trend) AS s FROM dec1 GROUP BY 1, 2, 3) AS m""",
           "rd0": """SELECT d.*, s.seasonal_index, d.y - d.trend - s.seasonal_index AS resid FROM dec1 d
        LEFT JOIN rs0 s ON d.tenant = s.tenant AND d.series = s.series AND d.moy = s.moy"""}
    for r in range(1, rounds + 1):
        out[f"rw{r}"] = f"""SELECT tenant, series, month, moy, y, seasonal_index AS before, trend IS NOT NULL AS whole,
            CASE WHEN resid IS NULL THEN 1.0 WHEN abs(resid) >= far THEN 0.0 ELSE pow(1 - pow(resid / far, 2), 2) END AS w
            FROM (SELECT *, 6 * median(abs(resid)) OVER (PARTITION BY tenant, series) + 1e-9 AS far FROM rd{r - 1}) AS x"""
        out[f"rz{r}"] = f"SELECT *, w * (y - coalesce(before, 0)) AS wz FROM rw{r}"
        out[f"rt{r}"] = f"SELECT *, CASE WHEN whole THEN {smooth('wz')} / nullif({smooth('w')}, 0) END AS trend FROM rz{r}"
        out[f"rs{r}"] = f"""SELECT tenant, series, moy, s - avg(s) OVER (PARTITION BY tenant, series) AS seasonal_index FROM (
            SELECT tenant, series, moy, sum(w * (y - trend)) / nullif(sum(CASE WHEN y - trend IS NOT NULL THEN w END), 0) AS s FROM rt{r} GROUP BY 1, 2, 3) AS m"""
        out[f"rd{r}"] = f"""SELECT d.*, s.seasonal_index, d.y - d.trend - s.seasonal_index AS resid FROM rt{r} d
            LEFT JOIN rs{r} s ON d.tenant = s.tenant AND d.series = s.series AND d.moy = s.moy"""
    return out


CTE |= robust_ctes()


@register("fc_decompose", sql=ow(*PREP, "dec0", "dec1", *robust_ctes()) + f"SELECT tenant, series, month, y, trend, seasonal_index, resid FROM rd{ROUNDS}",
          dbl=["y", "trend", "seasonal_index", "resid"], dates=("month",))
def q_decompose(spark, d):
    """Moving-average trend, centred monthly seasonal index and residual (log1p scale) after two rounds of bisquare weights."""
    return FC.decompose(long(spark, d), robust=ROUNDS).select("tenant", "series", "month", "y", "trend", "seasonal_index", "resid")


@register("fc_seasonal_index", sql=ow(*PREP, "dec0", "dec1", "sidx") + """SELECT s.tenant, s.moy, avg(s.seasonal_index) AS donor_seasonal
    FROM sidx s WHERE s.series IN ('new_premium', 'renewal_premium') GROUP BY 1, 2""", dbl=["donor_seasonal"], dates=())
def q_sidx(spark, d):
    """Seasonal index by calendar month averaged over two donor series."""
    return FC.donor_season(FC.decompose(long(spark, d)), ["new_premium", "renewal_premium"])


@register("fc_log_trend", sql=ow(*PREP, "trend") + "SELECT * FROM trend", dbl=["slope", "intercept", "cagr"], dates=())
def q_log_trend(spark, d):
    """Line through log1p(value) since the trend start; CAGR = e^(12 slope) - 1."""
    return FC.log_trend(long(spark, d), TREND_START)


@register("fc_log_trend_capped", sql=ow(*PREP) + f"""SELECT tenant, series,
    CASE WHEN s0 > {FEE_CAP!r} THEN {FEE_CAP!r} ELSE s0 END AS slope,
    CASE WHEN s0 > {FEE_CAP!r} THEN yl - {FEE_CAP!r} * tl ELSE i0 END AS intercept, exp(s0 * 12) - 1 AS cagr
    FROM (SELECT tenant, series, regr_slope(y, t) AS s0, regr_intercept(y, t) AS i0, arg_max(y, t) AS yl, max(t) AS tl
          FROM (SELECT tenant, series, {T_SQL} AS t, ln(1 + value) AS y FROM long WHERE month >= DATE '{TREND_START}' AND value IS NOT NULL) AS x
          GROUP BY 1, 2) AS f""", dbl=["slope", "intercept", "cagr"], dates=())
def q_log_trend_cap(spark, d):
    """Slope capped at ln(1.5)/12 per month, re-anchored at the last point."""
    return FC.log_trend(long(spark, d), TREND_START, cap=FEE_CAP)


@register("win_seasonal_tile", sql=ow(*PREP, "hz", "f_naive") + "SELECT * FROM f_naive", dbl=["forecast"], dates=("month",))
def q_tile(spark, d):
    """Last 12 values repeated over 36 steps (step s -> position (s-1) mod 12)."""
    return FC.fc_seasonal_naive(long(spark, d))


FC_DBL = ["forecast"]


@register("fc_compare", sql=ow(*FCS, "wide") + "SELECT tenant, series, CAST(year(month) AS INTEGER) AS year, "
          + ", ".join(f"sum({m}) AS {m}" for m in MODELS) + " FROM wide WHERE "
          + " AND ".join(f"{m} IS NOT NULL" for m in MODELS) + " GROUP BY 1, 2, 3", dbl=MODELS, dates=())
def q_compare(spark, d):
    """Models aligned on common months, annual totals side by side."""
    return FC.compare(sql_forecasts(kept(spark, d)), MODELS)


@register("melt_models", sql=ow(*FCS, "wide") + """SELECT tenant, series, year, model, value FROM (SELECT tenant, series, CAST(year(month) AS INTEGER) AS year, """
          + ", ".join(f"sum({m}) AS {m}" for m in MODELS) + " FROM wide WHERE " + " AND ".join(f"{m} IS NOT NULL" for m in MODELS)
          + f" GROUP BY 1, 2, 3) UNPIVOT (value FOR model IN ({', '.join(MODELS)}))", dbl=["value"], dates=())
def q_melt(spark, d):
    """Wide model columns -> (year, series, model, value)."""
    return melt(FC.compare(sql_forecasts(kept(spark, d)), MODELS), ["tenant", "series", "year"], MODELS, "model", "value")


@register("fc_ensemble", sql=ow(*FCS, "ens") + "SELECT * FROM ens", dbl=FC_DBL, dates=("month",))
def q_ensemble(spark, d):
    """Equal-weight mean of the models per series and month."""
    return FC.ensemble(sql_forecasts(kept(spark, d)))


@register("fc_band", sql=ow(*FCS, "wide") + "SELECT *, least(" + ", ".join(MODELS) + ") AS low, greatest(" + ", ".join(MODELS)
          + ") AS high FROM wide", dbl=MODELS + ["low", "high"], dates=("month",))
def q_band(spark, d):
    """Min-max range across models per month."""
    return FC.band(sql_forecasts(kept(spark, d)), MODELS)


@register("agg_row_minmax", sql=ow(*FCS, "wide") + "SELECT tenant, series, month, least(" + ", ".join(MODELS) + ") AS low, greatest("
          + ", ".join(MODELS) + ") AS high FROM wide", dbl=["low", "high"], dates=("month",))
def q_row_minmax(spark, d):
    w = FC.band(sql_forecasts(kept(spark, d)), MODELS)
    lo, hi = model_range(MODELS)
    return w.select("tenant", "series", "month", lo.alias("low"), hi.alias("high"))


@register("fc_yoy", sql=ow(*FCS, "ens") + f"""SELECT y.tenant, y.year, y.topline, y.actual_months, y.topline / nullif(b.topline, 0) - 1 AS yoy FROM
    (SELECT tenant, CAST(year(month) AS INTEGER) AS year, sum(coalesce(a, f)) AS topline, count(a) AS actual_months FROM
       (SELECT coalesce(a.tenant, f.tenant) AS tenant, coalesce(a.month, f.month) AS month, a.a, f.f FROM
          (SELECT tenant, month, sum(value) AS a FROM long GROUP BY 1, 2) AS a
          FULL OUTER JOIN (SELECT tenant, month, sum(forecast) AS f FROM ens GROUP BY 1, 2) AS f
          ON a.tenant = f.tenant AND a.month = f.month) AS j GROUP BY 1, 2) AS y
    LEFT JOIN (SELECT tenant, sum(value) AS topline FROM long WHERE year(month) = {BASE_YEAR} GROUP BY 1) AS b ON y.tenant = b.tenant""",
          dbl=["topline", "yoy"], dates=())
def q_yoy(spark, d):
    """Annual topline (actual months where present, else forecast) vs the base-year actual."""
    lg = kept(spark, d)
    act = lg.groupBy("tenant", "month").agg(F.sum("value").alias("value"))
    ens = FC.ensemble(sql_forecasts(lg)).groupBy("tenant", "month").agg(F.sum("forecast").alias("forecast"))
    return FC.yoy(ens, act, BASE_YEAR)


INS = f"""SELECT l.tenant, l.series, l.month, l.value, exp(tr.intercept + tr.slope * {t_sql('l.month')} + coalesce(s.seasonal_index, 0)) - 1 AS forecast
    FROM long l JOIN trend tr ON l.tenant = tr.tenant AND l.series = tr.series
    LEFT JOIN sidx s ON l.tenant = s.tenant AND l.series = s.series AND s.moy = month(l.month)"""


@register("fc_mape", sql=ow(*PREP, "dec0", "dec1", "sidx", "trend") + f"""SELECT tenant, series, 'trend_season' AS model,
    avg(abs(value - forecast) / greatest(value, 1)) * 100 AS mape FROM
    (SELECT *, row_number() OVER (PARTITION BY tenant, series ORDER BY month DESC) AS rn FROM ({INS}) AS i) AS x
    WHERE rn <= 12 GROUP BY 1, 2""", dbl=["mape"], dates=())
def q_mape(spark, d):
    """MAPE of the trend+season fit over each series' last 12 months."""
    lg = kept(spark, d)
    tr = FC.log_trend(lg, TREND_START)
    s = FC.seasonal_by_month(FC.decompose(lg))
    ins = lg.join(tr, ["tenant", "series"]).withColumn("moy", F.month("month")).join(s, ["tenant", "series", "moy"], "left")
    f = ins.select("tenant", "series", "month", F.lit("trend_season").alias("model"),
                   F.expm1(F.col("intercept") + F.col("slope") * FC.month_index(F.col("month"))
                           + F.coalesce(F.col("seasonal_index"), F.lit(0.0))).alias("forecast"))
    return FC.mape(lg.filter(F.col("value").isNotNull()), f, 12)


@register("agg_year_rollup", sql=ow(*PREP) + "SELECT tenant, series, CAST(year(month) AS INTEGER) AS year, sum(value) AS value FROM long GROUP BY 1, 2, 3",
          dbl=["value"], dates=())
def q_year(spark, d):
    return by_year(long(spark, d), "month", ["value"], keys=["tenant", "series"])


@register("agg_grand_total", sql=ow(*FCS, "ens") + """SELECT sum(CASE WHEN series = 'new_premium' THEN forecast END) AS new_premium,
    sum(CASE WHEN series = 'renewal_premium' THEN forecast END) AS renewal_premium, sum(CASE WHEN series = 'fees' THEN forecast END) AS fees,
    sum(forecast) AS topline_revenue FROM ens""", dbl=["new_premium", "renewal_premium", "fees", "topline_revenue"], dates=(), digits=2)
def q_grand(spark, d):
    e = FC.ensemble(sql_forecasts(kept(spark, d)))
    s = F.col("series")
    return grand_total(e, {"new_premium": F.sum(F.when(s == "new_premium", F.col("forecast"))),
                           "renewal_premium": F.sum(F.when(s == "renewal_premium", F.col("forecast"))),
                           "fees": F.sum(F.when(s == "fees", F.col("forecast"))),
                           "topline_revenue": F.sum("forecast")})


LAGS = ", ".join(f"lag(value, {i}) OVER (PARTITION BY tenant, series ORDER BY month) AS lag_{i}" for i in range(1, 13))


@register("win_lag_features", sql=ow(*PREP) + f"SELECT * FROM (SELECT tenant, series, month, value, {LAGS} FROM long) AS x WHERE lag_12 IS NOT NULL",
          dbl=["value"] + [f"lag_{i}" for i in range(1, 13)], dates=("month",))
def q_lags(spark, d):
    """12 lagged values per target; the first 12 rows of a series are dropped."""
    return lag_features(long(spark, d).select("tenant", "series", "month", "value"), ["tenant", "series"], "month", "value", 12)


@register("win_sequence_index", sql=ow(*PREP) + """SELECT tenant, series, month, CAST(row_number() OVER (PARTITION BY tenant, series ORDER BY month) - 1 AS INTEGER) AS t
    FROM long""", dates=("month",))
def q_seq(spark, d):
    return sequence_index(long(spark, d).select("tenant", "series", "month"), ["tenant", "series"], "month")


@register("win_first_last_value", sql=ow(*PREP) + """SELECT tenant, series, arg_min_null(value, month) AS first_value, arg_max_null(value, month) AS last_value
    FROM long GROUP BY 1, 2""", dbl=["first_value", "last_value"], dates=())
def q_first_last(spark, d):
    return first_last_value(long(spark, d), ["tenant", "series"], "month", "value")


@register("win_holdout_split", sql=ow(*PREP) + """SELECT tenant, series, month, value, row_number() OVER (PARTITION BY tenant, series ORDER BY month DESC) <= 12 AS is_holdout
    FROM long""", dbl=["value"], dates=("month",))
def q_holdout(spark, d):
    """Last 12 points of each series flagged as validation."""
    return split_holdout(long(spark, d).select("tenant", "series", "month", "value"), ["tenant", "series"], "month", 12)


@register("win_difference", sql=ow(*PREP) + """SELECT tenant, series, month, value, w1 - lag(w1, 12) OVER (PARTITION BY tenant, series ORDER BY month) AS value_diff FROM
    (SELECT *, value - lag(value, 1) OVER (PARTITION BY tenant, series ORDER BY month) AS w1 FROM long) AS x""",
          dbl=["value", "value_diff"], dates=("month",))
def q_diff(spark, d):
    """Ordinary (lag 1) then seasonal (lag 12) differencing."""
    return difference(long(spark, d).select("tenant", "series", "month", "value"), ["tenant", "series"], "month", "value", d=1, D=1, m=12)


@register("fn_math", sql=ow(*PREP) + """SELECT tenant, series, month, ln(1 + value) AS log1p_value, exp(ln(1 + value)) - 1 AS roundtrip,
    abs(value - lag(value) OVER (PARTITION BY tenant, series ORDER BY month)) AS abs_change,
    least(greatest(value, 10000), 500000) AS clipped, sin(month(month)) + cos(month(month)) AS trig FROM long""",
          dbl=["log1p_value", "roundtrip", "abs_change", "clipped", "trig"], dates=("month",))
def q_math(spark, d):
    """log1p, expm1, abs, clip (= least(greatest)), sin, cos."""
    lg = long(spark, d)
    w = Window.partitionBy("tenant", "series").orderBy("month")
    return lg.select("tenant", "series", "month", F.log1p("value").alias("log1p_value"),
                     F.expm1(F.log1p("value")).alias("roundtrip"),
                     F.abs(F.col("value") - F.lag("value").over(w)).alias("abs_change"),
                     clip("value", 10000, 500000).alias("clipped"),
                     (F.sin(F.month("month")) + F.cos(F.month("month"))).alias("trig"))


@register("fn_date", sql=ow() + """SELECT policy_id, CAST(date_trunc('month', effective_date) AS DATE) AS month, CAST(year(effective_date) AS INTEGER) AS year,
    CAST(month(effective_date) AS INTEGER) AS moy, strftime(effective_date, '%b %Y') AS label, effective_date - 3 AS minus3,
    CAST(len(generate_series(CAST(date_trunc('month', effective_date) AS DATE), greatest(CAST(date_trunc('month', effective_date) AS DATE), DATE '2001-07-01'), INTERVAL 1 MONTH)) AS INTEGER) AS months_left
    FROM policies""", dates=("month", "minus3"))
def q_date(spark, d):
    """Month truncation, year, month, text label, +/- days, month ranges."""
    p = policies(spark, d)
    m = F.trunc("effective_date", "month")
    return p.select("policy_id", m.alias("month"), F.year("effective_date").alias("year"), F.month("effective_date").alias("moy"),
                    F.date_format("effective_date", "MMM yyyy").alias("label"), F.date_sub("effective_date", 3).alias("minus3"),
                    F.size(F.sequence(m, F.greatest(m, F.to_date(F.lit("2001-07-01"))), F.expr("INTERVAL 1 MONTH"))).alias("months_left"))


# ------------------------------------------------------------------ model fits (rows-only)
PREMIUMS = ["new_premium", "renewal_premium"]
TRAIN_STARTS = {"new_premium": "1996-01-01", "renewal_premium": "1996-01-01", "fees": "1998-07-01"}
TREND_STARTS = {"new_premium": TREND_START, "renewal_premium": "1997-01-01", "fees": TREND_START}
AR_STARTS = {"renewal_premium": "1996-01-01"}
RATE_START = "1998-01-01"
KEYS = ["tenant", "series"]


def _train(lg, holdout=0):
    """Each series from its own training start, clipped to its 2.5 / 97.5 % quantiles (fees: 5 / 95 %) of the months before the
    last ``holdout``, which stay as rows without a value."""
    tr = SM.since(lg, TRAIN_STARTS)
    if holdout:
        last = F.add_months(F.max("month").over(Window.partitionBy(*KEYS)), -holdout)
        tr = tr.withColumn("_cut", last).withColumn("value", F.when(F.col("month") <= F.col("_cut"), F.col("value"))).drop("_cut")
    fees = F.col("series") == "fees"
    return FC.winsorise(tr.filter(~fees), 0.025, 0.975).unionByName(FC.winsorise(tr.filter(fees), 0.05, 0.95))


def _saturating(train, holdout=0):
    donor = SM.year_shape(train.filter(F.col("series") == "new_premium"), holdout=holdout).select("tenant", "moy", "shape")
    return SM.saturating(train.filter(F.col("series") == "fees"), donor, SPIKE, 12 if holdout else 36, holdout=holdout)


def _sarima(lg, holdout=0):
    return SM.sarima(SM.since(lg, AR_STARTS).filter(F.col("series").isin(PREMIUMS)), 12 if holdout else 36, holdout)


def _fee_rate(lg, premium, holdout=0):
    wide = lg.groupBy("tenant", "month").agg(*[F.max(F.when(F.col("series") == s, F.col("value"))).alias(s) for s in [*PREMIUMS, "fees"]],
                                             F.max(F.when(F.col("series") == "fees", F.col("policy_count"))).alias("policy_count"))
    rates = wide.filter(F.col("month") >= F.lit(RATE_START).cast("date")).select(
        "tenant", "month", safe_div(F.col("fees"), F.col("new_premium") + F.col("renewal_premium")).alias("rate"), "policy_count")
    return SM.fee_rate(rates, premium, FC.donor_season(FC.decompose(lg, robust=ROUNDS), PREMIUMS), SPIKE, 12 if holdout else 36, holdout)


def _residual(lg):
    """The learner is fitted on all series' months but the last twelve of each."""
    rows = SM.residual_rows(lg, TREND_STARTS, SPIKE, cap_slope={"fees": FEE_CAP})
    feats = SM.residual_features()
    lags = [f"lag_{i}" for i in range(1, 13)]
    known = F.max(F.when(~F.col("is_future"), F.col("month"))).over(Window.partitionBy(*KEYS))
    data = rows.withColumn("_known", known).filter((F.col("month") <= F.add_months("_known", -12)) & F.col("sc").isNotNull()).select("sc", *lags, *feats)
    va = VectorAssembler(inputCols=[*lags, *feats], outputCol="x", handleInvalid="skip")
    lr = LinearRegression(featuresCol="x", labelCol="sc", regParam=0.01).fit(va.transform(data))
    coef = [float(c) for c in lr.coefficients]
    return SM.residual_rollout(rows, float(lr.intercept), coef[:12], dict(zip(feats, coef[12:])))


def _premium(sarima):
    return sarima.groupBy("tenant", "month").agg(F.sum("forecast").alias("prem"))


def _models(lg):
    """The three models' forecasts of the three series, each series by its own form of the model."""
    tr, ar = _train(lg), cut_lineage(_sarima(lg))
    cols = [*KEYS, "month", "forecast"]
    parts = {"additive": [SM.additive(tr.filter(F.col("series").isin(PREMIUMS))), _saturating(tr)],
             "residual": [_residual(lg).filter("is_future")], "seasonal_arma": [ar, _fee_rate(lg, _premium(ar))]}
    out = [f.select(*cols, F.lit(m).alias("model")) for m, fs in parts.items() for f in fs]
    return reduce(lambda a, b: a.unionByName(b), out)


@register("fc_additive", dates=("month",))
def q_additive(spark, d):
    """Ridge fit of log value on the trend bends it needs, the year's harmonics and policy count, 36 steps, capped at 2x last."""
    return SM.additive(_train(kept(spark, d)))


@register("fc_trend_bends", dates=())
def q_bends(spark, d):
    """Per series the number of its trend's bends, chosen out of 25 candidates, and their months."""
    tr = _train(kept(spark, d))
    months = F.sort_array(F.collect_list(F.date_format("month", "yyyy-MM")))
    found = SM.trend_bends(tr).groupBy(*KEYS).agg(F.count("*").alias("n_bends"), F.array_join(months, " ").alias("bends"))
    return tr.select(*KEYS).distinct().join(found, KEYS, "left").fillna({"n_bends": 0, "bends": ""})


@register("fc_logistic_borrowed", dates=("month",))
def q_saturating(spark, d):
    """Fees: growth between floor and cap with policy count and spike, plus half the donor's yearly shape."""
    return _saturating(_train(kept(spark, d)))


@register("fc_order_search")
def q_orders(spark, d):
    """AIC of every order per series on one sample, differences chosen by tests before; the chosen order is the minimum."""
    return SM.order_table(SM.seasonal_arma(SM.log_input(SM.since(kept(spark, d), AR_STARTS)), {"pol": True}))


@register("fc_sarima", dates=("month",))
def q_sarima(spark, d):
    """Seasonal autoregressive moving average of the chosen order for every series, 36 steps with 95 % bounds."""
    return SM.sarima(SM.since(kept(spark, d), AR_STARTS))


@register("fc_fee_rate", dates=("month",))
def q_fee_rate(spark, d):
    """fees / total premium, de-seasoned by the donor index, autoregressive moving average with policy count and spike,
    capped at +50%/yr, times the premium forecast (joined on tenant, month)."""
    lg = kept(spark, d)
    return _fee_rate(lg, _premium(_sarima(lg)))


@register("fc_residual_learner", dates=("month",))
def q_residual(spark, d):
    """Residuals after trend and season: one linear model over 12 lags of residual, policy count and spike and the
    month's waves (all series), rolled out per series; levels of the known months and of 36 more."""
    return _residual(kept(spark, d))


@register("fc_models", dates=("month",))
def q_models(spark, d):
    """Forecasts of the additive, residual and seasonal-AR models for every series."""
    return _models(kept(spark, d))


@register("fc_model_ensemble", dates=("month",))
def q_model_ensemble(spark, d):
    """Equal-weight mean of the three models per month, with total premium and topline."""
    return FC.totals(FC.ensemble(_models(kept(spark, d))))


@register("fc_model_yoy", dates=())
def q_model_yoy(spark, d):
    """Annual topline of every model and of their mean against the base-year actual."""
    lg = kept(spark, d)
    models = cut_lineage(_models(lg))
    both = models.unionByName(FC.ensemble(models).withColumn("model", F.lit("ensemble")))
    top = both.groupBy("tenant", "model", "month").agg(F.sum("forecast").alias("forecast"))
    act = lg.groupBy("tenant", "month").agg(F.sum("value").alias("value")).join(top.select("tenant", "model").distinct(), "tenant")
    return FC.yoy(top, act, BASE_YEAR, ["tenant", "model"])


@register("fc_holdout_mape", dates=())
def q_holdout_mape(spark, d):
    """MAPE per series and model on the last 12 months, which no fit has seen."""
    lg = kept(spark, d)
    actual = lg.filter(F.col("value").isNotNull())
    ar = _sarima(lg, 12)
    premium = actual.filter(F.col("series").isin(PREMIUMS)).groupBy("tenant", "month").agg(F.sum("value").alias("prem"))
    fees = _fee_rate(lg, premium, 12).withColumn("model", F.lit("seasonal_arma"))
    res = _residual(lg).filter("NOT is_future").withColumn("model", F.lit("residual"))
    tr = _train(lg, 12)
    add = SM.additive(tr.filter(F.col("series").isin(PREMIUMS)), 12, holdout=12)
    sat = _saturating(tr, 12)
    cols = [*KEYS, "month", "model", "forecast"]
    return FC.mape(actual, reduce(lambda a, b: a.unionByName(b), [f.select(*cols) for f in (ar, fees, res, add, sat)]))
