"""Registered single-operator queries (projections, predicates, joins,
aggregates, sorting, scalar functions) over the derived inputs, with oracles."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ledgerline.functions.exprs import compact_json, safe_div, strict_div, weighted_avg
from ledgerline.operators.aggregates import cost_basis, daily_sum
from ledgerline.operators.filters import keep_cols, since, tiered_rate_expr, with_const, with_derived
from ledgerline.operators.joins import full_on
from ledgerline.operators.ordering import newest_first
from ledgerline.plans import bindings as B
from ledgerline.plans import token as T
from ledgerline.plans.catalog_token import CTE, MARKET, NEW, tier
from ledgerline.plans.registry import register
from ledgerline.session import checkpoint_dir
from ledgerline.sources.tables import read_table


def b(spark, d, n):
    return B.binding(spark, d, n)


def ow(names, extra=None):
    return B.oracle_with(names, extra)


@register("scan_table", sql="SELECT * FROM orders", dbl=["o_totalprice"], dates=())
def q_scan(spark, d):
    """A whole table by name (lazy; later projections prune the scan)."""
    return read_table(spark, "orders", d)


@register("project_derived", sql=ow(["sales"]) + """SELECT *, price * quantity AS amount, CAST(payment_at AS DATE) AS day FROM sales""",
          dbl=["price", "quantity", "usd_amount", "amount"], dates=("day",))
def q_derived(spark, d):
    """``SELECT *`` plus computed columns."""
    return with_derived(b(spark, d, "sales"), {"amount": F.col("price") * F.col("quantity"), "day": F.to_date("payment_at")})


@register("project_prune", sql=ow(["kpi_dungeon"]) + "SELECT Day, mission, Players FROM kpi_dungeon", dates=("Day",))
def q_prune(spark, d):
    """Keep the named columns that exist (an absent name is ignored)."""
    return keep_cols(b(spark, d, "kpi_dungeon"), ["Day", "mission", "Players", "not_a_column"])


@register("project_const", sql=ow(["users"]) + "SELECT id, -1 AS cluster, DATE '2024-01-30' AS run_date, 0 AS padded FROM users",
          dates=("run_date",))
def q_const(spark, d):
    """Literal columns (cluster -1, run date, zero padding)."""
    u = b(spark, d, "users").select("id")
    return with_const(u, {"cluster": -1, "padded": 0}).withColumn("run_date", F.to_date(F.lit("2024-01-30")))


@register("filter_compare", sql=ow(["chest"]) + """SELECT * FROM chest WHERE token_grant > 30 AND day < TIMESTAMP '1998-01-01 00:00:00'
    AND token_price != 1""", dbl=["token_grant", "token_price", "premium_usd_deducted", "token_usd_deducted"], dates=())
def q_compare(spark, d):
    c = b(spark, d, "chest")
    return c.filter((F.col("token_grant") > 30) & (F.col("day") < F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
                    & (F.col("token_price") != 1))


@register("filter_in_list", sql=ow(["currency_tx"]) + "SELECT source_id, transaction_source FROM currency_tx WHERE transaction_source IN ('craft', 'game')",
          dates=())
def q_in_list(spark, d):
    return b(spark, d, "currency_tx").filter(F.col("transaction_source").isin("craft", "game")).select("source_id", "transaction_source")


@register("filter_like", sql=ow(["booster_crafts", "sinks_long"]) + """SELECT 'slug' AS kind, recipe_slug AS name, count(*) AS n FROM booster_crafts
    WHERE recipe_slug LIKE '%ring_%' GROUP BY 1, 2
    UNION ALL SELECT 'craft', craft_name, count(*) FROM sinks_long WHERE craft_name LIKE '%$ring%' AND craft_name NOT LIKE 'small%' GROUP BY 1, 2""",
          dates=())
def q_like(spark, d):
    """``_`` is a one-character wildcard ('ring' does not match '%ring_%'); ``$`` is literal."""
    a = b(spark, d, "booster_crafts").filter(F.col("recipe_slug").like("%ring_%")).groupBy(
        F.lit("slug").alias("kind"), F.col("recipe_slug").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    s = b(spark, d, "sinks_long").filter(F.col("craft_name").like("%$ring%") & ~F.col("craft_name").like("small%")).groupBy(
        F.lit("craft").alias("kind"), F.col("craft_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(s)


@register("filter_compound", sql=ow(["dungeon_runs"]) + """SELECT instance_id, portal_type, mission FROM dungeon_runs
    WHERE (mission IS NULL OR mission NOT LIKE '%Intro%') AND (portal_type IN ('PvP', 'Portal') OR (portal_type = 'Party' AND member_1 IS NOT NULL))""",
          dates=())
def q_compound(spark, d):
    """Nested AND/OR with NULL-tolerant halves written out."""
    r = b(spark, d, "dungeon_runs")
    m = F.col("mission")
    return r.filter((m.isNull() | ~m.like("%Intro%"))
                    & (F.col("portal_type").isin("PvP", "Portal") | ((F.col("portal_type") == "Party") & F.col("member_1").isNotNull()))) \
            .select("instance_id", "portal_type", "mission")


@register("filter_relative", sql=ow(["grant_tx"]) + f"""SELECT id, created_at FROM grant_tx WHERE created_at > TIMESTAMP '{B.GRANTS_AS_OF}' - INTERVAL 180 DAY""",
          dates=())
def q_relative(spark, d):
    """Rows of the last 180 days before an ``as_of`` parameter."""
    return since(b(spark, d, "grant_tx"), "created_at", B.GRANTS_AS_OF, 180).select("id", "created_at")


@register("case_tiered_rate", sql=ow(["sales"]) + f"""SELECT payment_at, game_name, type, subtype,
    CASE WHEN game_name = '{B.PRIMARY_GAME}' THEN {tier(True)} END AS game_revenue,
    CASE WHEN game_name = '{B.PRIMARY_GAME}' THEN {tier(True)} WHEN game_name != '{B.PRIMARY_GAME}' THEN {tier(False)} END AS platform_revenue
    FROM sales WHERE payment_currency = 'USD'""", dbl=["game_revenue", "platform_revenue"], dates=())
def q_tiered(spark, d):
    """Nested CASE choosing a rate by game, type and subtype (no ELSE for other games)."""
    s = b(spark, d, "sales").filter(F.col("payment_currency") == "USD")
    g, p = tiered_rate_expr("game_name", "type", "subtype", "price", "quantity", T.DEFAULT_RATES, B.PRIMARY_GAME)
    return s.select("payment_at", "game_name", "type", "subtype", g.alias("game_revenue"), p.alias("platform_revenue"))


@register("case_null_default", sql=ow(["chest"]) + """SELECT day, coalesce(token_grant, 0) AS token_grant, coalesce(token_usd_deducted, premium_usd_deducted, 0) AS deducted
    FROM chest""", dbl=["token_grant", "deducted"], dates=())
def q_null_default(spark, d):
    c = b(spark, d, "chest")
    return c.select("day", F.coalesce("token_grant", F.lit(0.0)).alias("token_grant"),
                    F.coalesce("token_usd_deducted", "premium_usd_deducted", F.lit(0.0)).alias("deducted"))


@register("safe_divide", sql=ow(["chest"]) + "SELECT day, premium_usd_deducted / nullif(token_grant, 0) AS per_grant FROM chest",
          dbl=["per_grant"], dates=())
def q_safe(spark, d):
    """NULL on a zero or NULL denominator (never raises under ANSI)."""
    return b(spark, d, "chest").select("day", safe_div("premium_usd_deducted", "token_grant").alias("per_grant"))


@register("strict_divide", sql="SELECT l_orderkey, l_linenumber, l_extendedprice / (l_quantity + 0.07) AS unit_price FROM lineitem",
          dbl=["unit_price"], dates=())
def q_strict(spark, d):
    """Unguarded ratio: a zero denominator raises DIVIDE_BY_ZERO under ANSI mode."""
    li = read_table(spark, "lineitem", d)
    return li.select("l_orderkey", "l_linenumber", strict_div("l_extendedprice", F.col("l_quantity") + 0.07).alias("unit_price"))


@register("join_left_equi", sql=ow(["race_costs", "token_prices"], {"prices_d": CTE["prices_d"]})
          + """SELECT CAST(a.created_at AS DATE) AS day, a.token_grant, p.avg_token_price FROM race_costs a LEFT JOIN prices_d p
    ON CAST(a.created_at AS DATE) = p.day""", dbl=["token_grant", "avg_token_price"])
def q_left_equi(spark, d):
    """Lookup enrichment by a left equi-join (Spark sizes the build side itself)."""
    r = b(spark, d, "race_costs").select(F.to_date("created_at").alias("day"), "token_grant")
    return r.join(T.daily_prices(b(spark, d, "token_prices")), "day", "left")


@register("join_full_outer", sql=ow(["sinks_long", "sales"], {"new_d": CTE["new_d"], "market_d": CTE["market_d"]})
          + """SELECT coalesce(c.day, m.day) AS day, c.token_sunk, m.marketplace_fee_usd FROM new_d c FULL OUTER JOIN market_d m ON c.day = m.day""",
          dbl=["token_sunk", "marketplace_fee_usd"])
def q_full(spark, d):
    """Two daily tables, ``coalesce(c.day, m.day)`` as the key."""
    c = T.new_craft_cost(b(spark, d, "sinks_long"), **NEW).select("day", "token_sunk")
    m = T.marketplace_fee(b(spark, d, "sales"), **MARKET)
    return full_on(c, m, "day")


@register("agg_daily_sum", sql=ow(["booster_spend"]) + """SELECT CAST(day_hour AS DATE) AS day, sum(portal_usd) AS portal_usd, sum(prestige_usd) AS prestige_usd
    FROM booster_spend GROUP BY 1""", dbl=["portal_usd", "prestige_usd"])
def q_daily_sum(spark, d):
    return daily_sum(b(spark, d, "booster_spend"), "day_hour", ["portal_usd", "prestige_usd"])


@register("agg_weighted_avg", sql=ow(["chest"]) + """SELECT CAST(day AS DATE) AS day, sum(token_price * token_grant) / nullif(sum(token_grant), 0) AS weighted_price
    FROM chest GROUP BY 1""", dbl=["weighted_price"])
def q_weighted(spark, d):
    """sum(p * q) / sum(q), NULL-safe."""
    return b(spark, d, "chest").groupBy(F.to_date("day").alias("day")).agg(weighted_avg("token_price", "token_grant").alias("weighted_price"))


@register("agg_cost_basis", sql=ow(["chest"]) + """SELECT CAST(day AS DATE) AS day,
    sum(premium_usd_deducted) / nullif(sum(coalesce(token_grant, 0)), 0) AS cost_basis,
    sum(premium_usd_deducted) / nullif(sum(token_grant), 0) AS cost_basis_raw FROM chest GROUP BY 1""", dbl=["cost_basis", "cost_basis_raw"])
def q_cost_basis(spark, d):
    """Spend / grants per day; one variant coalesces the denominator, the other not."""
    c = b(spark, d, "chest")
    return c.groupBy(F.to_date("day").alias("day")).agg(
        cost_basis(F.col("premium_usd_deducted"), F.col("token_grant")).alias("cost_basis"),
        cost_basis(F.col("premium_usd_deducted"), F.col("token_grant"), coalesce_denominator=False).alias("cost_basis_raw"))


@register("sort_desc", sql=ow(["sales"], {"revenue_d": CTE["revenue_d"]}) + "SELECT * FROM revenue_d ORDER BY day DESC NULLS LAST",
          dbl=["game_revenue", "platform_revenue"])
def q_sort(spark, d):
    """Newest day first, NULLs last."""
    return newest_first(T.daily_revenue(b(spark, d, "sales"), B.PRIMARY_GAME), "day")


@register("fn_round", sql=ow(["sales"]) + """SELECT payment_at, round(usd_amount, 0) AS r0, round(usd_amount, 2) AS r2 FROM sales""",
          dbl=["r0", "r2"], dates=())
def q_round(spark, d):
    """ROUND(x, 0) and ROUND(x, 2), half away from zero."""
    s = b(spark, d, "sales")
    return s.select("payment_at", F.round("usd_amount", 0).alias("r0"), F.round("usd_amount", 2).alias("r2"))


def _json_sql() -> str:
    from ledgerline.plans.catalog_report import KPI_SQL, ow as kow
    cols = ["date", "revenue_today", "revenue_dod_pct", "revenue_vs7d_avg_pct", "revenue_vs30d_avg_pct", "buyers",
            "transactions", "revenue_avg_7d", "revenue_avg_30d", "dau_today", "dau_dod_pct", "dau_vs7d_avg_pct",
            "dau_vs30d_avg_pct", "dau_avg_7d", "dau_avg_30d", "avg_time_today_min"]
    return kow({"k": KPI_SQL}) + "SELECT to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in cols) + ")) AS json FROM k"


@register("fn_to_json", sql=_json_sql(), round_result=False, dates=())
def q_to_json(spark, d):
    """Compact JSON of a record (NULL fields kept)."""
    from ledgerline.plans.catalog_report import kpis
    k = kpis(spark, d)
    return k.select(compact_json(F.struct(*k.columns)).alias("json"))


@register("sink_append_snapshot", sql=ow(["cluster_history"]) + "SELECT user_id, ga_id, cluster, cluster_name, DATE '2024-01-30' AS run_date FROM cluster_history",
          dates=("run_date",))
def q_append(spark, d):
    """Append labelled users under a run date twice; the rerun replaces its partition."""
    from ledgerline.sources.sinks import append_snapshot
    path = os.path.join(checkpoint_dir(spark), "snapshots", uuid.uuid4().hex)
    h = b(spark, d, "cluster_history").drop("run_date")
    append_snapshot(h, path, "2024-01-30")
    return append_snapshot(h, path, "2024-01-30")


@register("agg_group_ordinals", sql=ow(["grant_tx"]) + """SELECT CAST(created_at AS DATE) AS day, status, sum(amount) AS amount, count(*) AS n
    FROM grant_tx GROUP BY 1, 2""", dbl=["amount"])
def q_group_ordinals(spark, d):
    """``GROUP BY 1, 2`` (positional keys) through Spark SQL over a DataFrame parameter."""
    return spark.sql("SELECT CAST(created_at AS DATE) AS day, status, sum(amount) AS amount, count(*) AS n "
                     "FROM {t} GROUP BY 1, 2", t=b(spark, d, "grant_tx"))
