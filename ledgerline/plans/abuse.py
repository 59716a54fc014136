"""Reward-abuse and telemetry profiling: daily grants per user, a percentile
threshold, suspension lengths, and distribution profiles (describe, histogram,
density, exact-n sample).  The threshold is a one-row aggregate read as a scalar
subquery, so flagging is a filter, not a join."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions.exprs import scalar_json
from ledgerline.operators.stats import describe_exact, exact_quantiles, histogram
from ledgerline.session import cut_lineage


def daily_grants(tx: DataFrame, users: DataFrame, *, token_id: str, pattern: str, action: str = "grant") -> DataFrame:
    """Grants whose lower-cased JSON sourceString matches ``pattern``, per
    (day, user, name, country, source): distinct transactions and amount."""
    src = scalar_json("extra", "$.sourceString")
    g = (tx.filter((F.col("token_id") == token_id) & (F.col("action") == action) & F.lower(src).like(pattern))
           .select(F.to_date("created_at").alias("Day"), "user_id", src.alias("sourceString"), "amount", "id"))
    u = users.select(F.col("id").alias("user_id"), "username", "country_code")
    return (g.join(u, "user_id", "left")
             .groupBy("Day", "user_id", "username", "country_code", "sourceString")
             .agg(F.count_distinct("id").alias("reward_txs"), F.sum("amount").alias("daily_reward")))


def flag_above(df: DataFrame, col: str, p: float, as_of, days: int = 30, date_col: str = "Day") -> DataFrame:
    """Rows of the last ``days`` before ``as_of`` whose ``col`` is strictly above the
    exact ``p`` quantile of those rows.  Adds the threshold as a column."""
    # the threshold takes several passes over the recent rows and the filter one more: they are written to the
    # checkpoint folder once
    recent = cut_lineage(df.filter(F.col(date_col) > F.date_sub(F.to_date(F.lit(str(as_of))), days)))
    thr = exact_quantiles(recent, col, [p]).select("q").scalar()     # exact, two-pass, one scalar
    return recent.withColumn("threshold", thr).filter(F.col(col) > F.col("threshold"))


def suspensions(flagged: DataFrame, keys: Sequence[str] = ("user_id", "username", "country_code"),
                col: str = "reward_txs", date_col: str = "Day", allowance: int = 2) -> DataFrame:
    """Per user: distinct flagged days, total flagged transactions and
    ``total - allowance * days`` suspension days.  Rows with a NULL key are
    dropped first (as a pandas group-by does)."""
    f = flagged.dropna(subset=list(keys))
    return (f.groupBy(*keys).agg(F.count_distinct(date_col).alias("unique_days"), F.sum(col).alias("total_reward_txs"))
             .withColumn("suspended_days", F.col("total_reward_txs") - F.lit(allowance) * F.col("unique_days"))
             .orderBy(F.col("total_reward_txs").desc(), *[F.col(k) for k in keys]))


def telemetry_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numeric-as-text telemetry cast to double (bad text -> NULL)."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def telemetry_profile(df: DataFrame, cols: Sequence[str], bins: int = 20) -> DataFrame:
    """Histogram of every column (stacked to (measure, value), one job) with each
    column's own mean for the overlay line."""
    num = telemetry_numeric(df, cols)
    stacked = num.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("x")) for c in cols]))
                         .alias("s")).select("s.measure", "s.x")
    return histogram(stacked, "x", bins=bins, by=["measure"])


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return describe_exact(telemetry_numeric(df, cols), cols)
