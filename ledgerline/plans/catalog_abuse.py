"""Registered abuse / telemetry queries (Spark) and their DuckDB oracles."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ledgerline.functions.exprs import hash_id, ilike_pattern, scalar_json, to_double
from ledgerline.operators.aggregates import active_over, day_sketches, distinct_count
from ledgerline.operators.ordering import sample_n
from ledgerline.operators.stats import histogram, kde, quantile, quantile_grid
from ledgerline.plans import abuse as A
from ledgerline.plans import bindings as B
from ledgerline.plans.catalog_token import sj
from ledgerline.plans.registry import register
from ledgerline.session import checkpoint_dir, cut_lineage
from ledgerline.sources.sinks import write_csv
from ledgerline.sources.tables import read_table

PATTERN = "%top band.%"
AS_OF = "2024-01-31"
TELEMETRY = ["raw_discrepancy", "current_discrepancy", "lifetime", "detected_count", "detected_window"]


def grants(spark, d):
    return A.daily_grants(B.binding(spark, d, "token_tx"), B.binding(spark, d, "users"), token_id=B.TOKEN_ID, pattern=PATTERN)


GRANTS_SQL = f"""SELECT CAST(g.created_at AS DATE) AS Day, g.user_id, u.username, u.country_code, {sj('g.extra', '$.sourceString')} AS sourceString,
    count(DISTINCT g.id) AS reward_txs, sum(g.amount) AS daily_reward
  FROM token_tx g LEFT JOIN users u ON g.user_id = u.id
  WHERE g.token_id = 'GEM' AND g.action = 'grant' AND lower({sj('g.extra', '$.sourceString')}) LIKE '{PATTERN}'
  GROUP BY 1, 2, 3, 4, 5"""
FLAG_SQL = f"""SELECT *, (SELECT quantile_cont(reward_txs, 0.9) FROM grants WHERE Day > DATE '{AS_OF}' - 30) AS threshold
  FROM grants WHERE Day > DATE '{AS_OF}' - 30"""


def ow(extra=None):
    return B.oracle_with(["token_tx", "users"], extra)


@register("abu_daily_grants", sql=ow() + GRANTS_SQL, dbl=["daily_reward"], dates=("Day",))
def q_grants(spark, d):
    return grants(spark, d)


@register("abu_threshold", sql=ow({"grants": GRANTS_SQL}) + f"SELECT * FROM ({FLAG_SQL}) AS f WHERE reward_txs > threshold",
          dbl=["daily_reward", "threshold"], dates=("Day",))
def q_threshold(spark, d):
    """Flag rows strictly above the exact 90th percentile of the last 30 days."""
    return A.flag_above(grants(spark, d), "reward_txs", 0.9, AS_OF, 30)


@register("abu_suspensions", sql=ow({"grants": GRANTS_SQL, "flagged": f"SELECT * FROM ({FLAG_SQL}) AS f WHERE reward_txs > threshold"})
          + """SELECT user_id, username, country_code, count(DISTINCT Day) AS unique_days, CAST(sum(reward_txs) AS BIGINT) AS total_reward_txs,
    CAST(sum(reward_txs) - 2 * count(DISTINCT Day) AS BIGINT) AS suspended_days FROM flagged
    WHERE user_id IS NOT NULL AND username IS NOT NULL AND country_code IS NOT NULL GROUP BY 1, 2, 3""", dates=())
def q_susp(spark, d):
    return A.suspensions(A.flag_above(grants(spark, d), "reward_txs", 0.9, AS_OF, 30))


@register("agg_quantile", sql=ow({"grants": GRANTS_SQL}) + "SELECT quantile_cont(reward_txs, 0.9) AS q FROM grants", dbl=["q"], dates=())
def q_quantile(spark, d):
    """Exact linearly-interpolated quantile (not approximate)."""
    return quantile(grants(spark, d), "reward_txs", 0.9)


@register("agg_quantile_grid", sql=ow({"grants": GRANTS_SQL}) + f"""SELECT round((i - 1) * 0.05, 10) AS p, qs[i] AS q
    FROM (SELECT quantile_cont(daily_reward, [{', '.join(str(round(i * 0.05, 10)) for i in range(21))}]) AS qs FROM grants) AS t,
    range(1, 22) AS r(i)""", dbl=["p", "q"], dates=())
def q_qgrid(spark, d):
    return quantile_grid(grants(spark, d), "daily_reward", 0.05)


@register("agg_distinct_count", sql=ow({"grants": GRANTS_SQL}) + """SELECT Day, count(DISTINCT user_id) AS users, count(DISTINCT sourceString) AS sources
    FROM grants GROUP BY Day""", dates=("Day",))
def q_distinct(spark, d):
    return distinct_count(grants(spark, d), ["Day"], {"users": "user_id", "sources": "sourceString"})


def telemetry(spark, d):
    return B.binding(spark, d, "telemetry")


TEL_SQL = B.oracle_with(["telemetry"])
STACK = " UNION ALL ".join(f"SELECT '{c}' AS measure, TRY_CAST({c} AS DOUBLE) AS x FROM telemetry" for c in TELEMETRY)


@register("agg_describe", sql=TEL_SQL + f"""SELECT measure, count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min,
    quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, max(x) AS max
    FROM ({STACK}) AS s GROUP BY measure""", dbl=["mean", "std", "min", "p25", "p50", "p75", "max"], dates=())
def q_describe(spark, d):
    """count, mean, sample sd, min, quartiles, max per telemetry column (exact)."""
    return A.describe(telemetry(spark, d), TELEMETRY)


def hist_sql(src: str, by: list[str], bins: int) -> str:
    k = ", ".join(by)
    kk = (k + ", ") if by else ""
    on = " AND ".join(f"b.{c} = s.{c}" for c in by) or "TRUE"
    return f"""WITH base AS ({src}),
    st AS (SELECT {kk}CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                 CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi, avg(x) AS mean
           FROM base WHERE x IS NOT NULL {'GROUP BY ' + k if by else ''})
    SELECT {', '.join('s.' + c for c in by) + ', ' if by else ''}r.bin AS bin, s.lo + r.bin * (s.hi - s.lo) / {bins} AS lo,
           s.lo + (r.bin + 1) * (s.hi - s.lo) / {bins} AS hi, coalesce(h.count, 0) AS count, s.mean AS mean
    FROM st s CROSS JOIN (SELECT CAST(unnest(range({bins})) AS INTEGER) AS bin) AS r LEFT JOIN (
         SELECT {', '.join('b.' + c for c in by) + ', ' if by else ''}CAST(least(floor((b.x - s.lo) / ((s.hi - s.lo) / {bins})), {bins - 1}) AS INTEGER) AS bin,
                 count(*) AS count
          FROM base b JOIN st s ON {on} WHERE b.x IS NOT NULL GROUP BY ALL) AS h ON h.bin = r.bin AND {on.replace('b.', 'h.')}"""


@register("agg_histogram", sql=TEL_SQL.rstrip("\n") + ",\n" + hist_sql("SELECT TRY_CAST(raw_discrepancy AS DOUBLE) AS x FROM telemetry", [], 20)[5:],
          dbl=["lo", "hi", "mean"], dates=())
def q_hist(spark, d):
    """20 equal-width bins over [min, max]; the maximum lands in the last bin."""
    return histogram(A.telemetry_numeric(telemetry(spark, d), TELEMETRY), "raw_discrepancy", bins=20)


@register("abu_telemetry_profile", sql=TEL_SQL.rstrip("\n") + ",\n" + hist_sql(STACK, ["measure"], 20)[5:],
          dbl=["lo", "hi", "mean"], dates=())
def q_profile(spark, d):
    """Histogram (20 bins) and mean of every telemetry column, in one job."""
    return A.telemetry_profile(telemetry(spark, d), TELEMETRY, bins=20)


@register("agg_kde", sql=ow({"grants": GRANTS_SQL}) + """, st AS (SELECT count(x) AS n, stddev_samp(x) * pow(count(x), -0.2) AS h,
      min(x) AS mn, max(x) AS mx FROM (SELECT CAST(reward_txs AS DOUBLE) AS x FROM grants) t),
    v AS (SELECT CAST(reward_txs AS DOUBLE) AS v, count(*) AS cnt FROM grants GROUP BY 1),
    g AS (SELECT i, st.mn - 3 * st.h + i * ((st.mx + 3 * st.h) - (st.mn - 3 * st.h)) / 199 AS x, st.n, st.h FROM range(0, 200) AS r(i), st)
    SELECT g.i AS point, g.x, sum(v.cnt * exp(-0.5 * ((g.x - v.v) / g.h) * ((g.x - v.v) / g.h))) * (1 / sqrt(2 * pi())) / (g.n * g.h) AS density
    FROM g, v GROUP BY g.i, g.x, g.n, g.h""", dbl=["x", "density"], dates=())
def q_kde(spark, d):
    """Gaussian density (Scott bandwidth) on a 200-point grid, the exact sum over all values."""
    return kde(grants(spark, d), "reward_txs", grid=200)


@register("sample_exact_n", sql=TEL_SQL + """SELECT * FROM telemetry ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id LIMIT 10000""",
          dates=())
def q_sample(spark, d):
    """Exactly 10,000 rows, seed 42, without replacement; deterministic under repartitioning."""
    return sample_n(telemetry(spark, d), "event_id", 10000, seed=42)


SAMPLE = 500        # rows of the sampled profile
SAMPLED = f"(SELECT * FROM telemetry ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id LIMIT {SAMPLE}) AS s"


@register("abu_telemetry_sample", sql=TEL_SQL.rstrip("\n") + ",\n" + hist_sql(STACK.replace("FROM telemetry", f"FROM {SAMPLED}"), ["measure"], 20)[5:],
          dbl=["lo", "hi", "mean"], dates=())
def q_profile_sample(spark, d):
    """The telemetry profile of an exact-size sample instead of all rows."""
    return A.telemetry_profile(sample_n(telemetry(spark, d), "event_id", SAMPLE, seed=42), TELEMETRY, bins=20)


@register("agg_active_users", dates=("day",))
def q_active(spark, d):
    """Active users of the last 1, 7 and 30 days per day, estimated from stored day sketches."""
    events = read_table(spark, "events", d).select(F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("user_id"))
    return active_over(cut_lineage(day_sketches(events, "day", "user_id")), "day", [1, 7, 30])


@register("fn_cast", sql=TEL_SQL + "SELECT event_id, " + ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in TELEMETRY) + " FROM telemetry",
          dbl=TELEMETRY, dates=())
def q_cast(spark, d):
    t = telemetry(spark, d)
    return t.select("event_id", *[to_double(c).alias(c) for c in TELEMETRY])


@register("fn_json_scalar", sql=B.oracle_with(["token_tx"]) + f"SELECT id, {sj('extra', '$.sourceString')} AS source_string FROM token_tx",
          dates=())
def q_json(spark, d):
    """JSON scalar at a path; objects/arrays at the path give NULL."""
    return B.binding(spark, d, "token_tx").select("id", scalar_json("extra", "$.sourceString").alias("source_string"))


@register("fn_lower_like", sql=B.oracle_with(["token_tx"]) + f"SELECT id FROM token_tx WHERE lower({sj('extra', '$.sourceString')}) LIKE '{PATTERN}'",
          dates=())
def q_lower_like(spark, d):
    t = B.binding(spark, d, "token_tx")
    return t.filter(ilike_pattern(scalar_json("extra", "$.sourceString"), PATTERN)).select("id")


@register("fn_hash", sql="SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR)) AS ga_id FROM customer", dates=())
def q_hash(spark, d):
    """Hex SHA-256 of the id text (anonymous join key)."""
    return read_table(spark, "customer", d).select("c_custkey", hash_id("c_custkey").alias("ga_id"))


@register("sink_csv", sql=ow({"grants": GRANTS_SQL, "flagged": f"SELECT * FROM ({FLAG_SQL}) AS f WHERE reward_txs > threshold"})
          + """SELECT strftime(Day, '%Y-%m-%d') AS "Day", CAST(user_id AS VARCHAR) AS user_id, username, country_code, sourceString,
    CAST(reward_txs AS VARCHAR) AS reward_txs FROM flagged""", dates=())
def q_sink_csv(spark, d):
    """Flagged rows written as CSV with a header into the checkpoint folder, read back."""
    out = os.path.join(checkpoint_dir(spark), "sink_csv", uuid.uuid4().hex)
    flagged = A.flag_above(grants(spark, d), "reward_txs", 0.9, AS_OF, 30)
    write_csv(flagged, out)
    back = spark.read.option("header", True).option("inferSchema", False).csv(out)
    return back.select("Day", "user_id", "username", "country_code", "sourceString", "reward_txs")


@register("sink_csv_bans", sql=ow({"grants": GRANTS_SQL, "flagged": f"SELECT * FROM ({FLAG_SQL}) AS f WHERE reward_txs > threshold"})
          + """SELECT CAST(user_id AS VARCHAR) AS user_id, username, country_code, CAST(count(DISTINCT Day) AS VARCHAR) AS unique_days,
    CAST(CAST(sum(reward_txs) AS BIGINT) AS VARCHAR) AS total_reward_txs, CAST(CAST(sum(reward_txs) - 2 * count(DISTINCT Day) AS BIGINT) AS VARCHAR) AS suspended_days
    FROM flagged WHERE user_id IS NOT NULL AND username IS NOT NULL AND country_code IS NOT NULL GROUP BY 1, 2, 3""", dates=())
def q_sink_bans(spark, d):
    """The suspension list written as CSV with a header into the checkpoint folder, read back."""
    out = os.path.join(checkpoint_dir(spark), "sink_csv_bans", uuid.uuid4().hex)
    write_csv(A.suspensions(A.flag_above(grants(spark, d), "reward_txs", 0.9, AS_OF, 30)), out)
    return spark.read.option("header", True).option("inferSchema", False).csv(out)
