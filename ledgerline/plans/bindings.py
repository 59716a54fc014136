"""Bindings: reference-shaped inputs derived by Spark from the driver tables.

Each binding is written once in the SQL subset shared by Spark and DuckDB.
Spark runs it with DataFrame parameters (``spark.sql(text, lineitem=df)``), so
the derived input is a lazy plan over the given tables (its size grows with
them); the oracle inlines the same text as CTEs.  Recipes, crafts, boosters, currency
payments and grant sources are named by the given tables' own values (part names, order
priorities, statuses, flags, and bands of the events' ``k``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources.tables import DRIVER_TABLES, read_table

# Names in the derived inputs and the dates used
# by the registered queries (data cover 1995-01-01..2001-11-04 for lineitem and
# orders, 2024-01-01..2024-01-30 for events).
PRIMARY_GAME = "Sky Forge"
TOKEN_ID = "GEM"
TRANSITION_DAY = "1998-12-30"      # new system starts after this day
OLD_UNTIL_DAY = "1998-12-31"       # old system runs to this day inclusive (one-day overlap)
OLD_AFTER_TS = "1995-06-01 00:00:00"
GRANTS_AS_OF = "2001-11-05 00:00:00"
RUN_DATE = "2024-01-30"
SEG_START = "2023-12-31 00:00:00"
SEG_END = "2024-01-31 00:00:00"
SEG_SPLIT = "2024-01-16"

BINDINGS: dict[str, str] = {
    # ---------------- token economy (lineitem / orders / part) ----------------
    "token_prices": """
        SELECT l_shipdate AS ts, l_extendedprice / l_quantity / 97.3 AS price
        FROM {lineitem}""",
    "sales": """
        SELECT l_shipdate AS payment_at,
               CASE l_returnflag WHEN 'R' THEN 'Sky Forge' WHEN 'A' THEN 'Other Game' END AS game_name,
               CASE WHEN l_tax = 0.08 THEN 'bundle' WHEN l_linestatus = 'O' THEN 'primary' ELSE 'secondary' END AS type,
               CASE WHEN l_discount < 0.05 THEN 'sale' WHEN l_discount < 0.09 THEN 'rental' ELSE 'gift' END AS subtype,
               CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_quantity / 1.07 END AS price,
               l_quantity AS quantity,
               CASE WHEN l_tax = 0 THEN 'EUR' ELSE 'USD' END AS payment_currency,
               CASE WHEN l_linenumber = 1 THEN 'premium-currency-package' ELSE 'item' END AS item_type,
               l_extendedprice * (1 - l_discount) / 1.07 AS usd_amount,
               CASE l_returnflag WHEN 'N' THEN 'Gem_Pack' ELSE 'Other_Pack' END AS item_archetype_id
        FROM {lineitem}""",
    "chest": """
        SELECT l_shipdate AS day,
               CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity END AS token_grant,
               l_extendedprice / l_quantity / 97.3 AS token_price,
               l_extendedprice * l_discount / 1.07 AS premium_usd_deducted,
               CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice * l_tax / 1.07 END AS token_usd_deducted
        FROM {lineitem} WHERE l_returnflag = 'A'""",
    "race_costs": """
        SELECT l_shipdate AS created_at, l_quantity AS token_grant,
               l_discount * 97.3 AS a_sunk, l_tax / 1.07 AS a_price,
               l_quantity AS b_sunk, CASE WHEN l_linestatus = 'O' THEN NULL ELSE CAST(0.53 AS DOUBLE) / 1.07 END AS b_price,
               CAST(l_linenumber AS DOUBLE) AS c_sunk, CAST(0.27 AS DOUBLE) / 1.07 AS c_price,
               l_quantity / 2.07 AS token_sunk, l_extendedprice / l_quantity / 97.3 AS token_price
        FROM {lineitem} WHERE l_returnflag = 'R'""",
    "booster_spend": """
        SELECT l_shipdate AS day_hour, l_extendedprice * l_discount / 1.07 AS portal_usd,
               l_extendedprice * l_tax / 1.07 AS prestige_usd, l_extendedprice / 9.73 AS workshop_usd,
               l_quantity AS booster_qty
        FROM {lineitem} WHERE l_returnflag = 'N'""",
    "booster_crafts": """
        SELECT l_shipdate AS event_arrival_ts,
               CASE split_part(p_name, ' ', 1) WHEN 'small' THEN split_part(p_name, ' ', 2)
                    ELSE split_part(p_name, ' ', 2) || '_' || split_part(p_name, ' ', 1) END AS recipe_slug,
               CASE WHEN l_linestatus = 'O' THEN 'Booster_Workshop' ELSE 'Booster_Portal' END AS cost_slug,
               l_quantity AS cost_total, l_extendedprice / l_quantity / 997.3 AS booster_unit_price
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "currency_tx": """
        SELECT o_orderdate AS created_at, o_orderstatus AS currency_id, CAST(o_orderkey AS STRING) AS source_id,
               CASE o_orderpriority WHEN '5-LOW' THEN 'shop' WHEN '4-NOT SPECIFIED' THEN 'game' ELSE 'craft' END AS transaction_source,
               CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'grant' ELSE 'deduct' END AS action,
               o_totalprice / 97.3 AS amount,
               CASE o_orderpriority WHEN '1-URGENT' THEN '{{"sourceString": "1-URGENT"}}'
                    WHEN '2-HIGH' THEN '{{"sourceString": {{"nested": 1}}}}'
                    ELSE '{{"sourceString": "Craft"}}' END AS extra,
               '[{{"archetypeId": "' || CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END
                 || '", "amount": "' || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING) || '"}}]' AS speed_up_payment
        FROM {orders}""",
    "currencies": """
        SELECT DISTINCT o_orderstatus AS id, CASE o_orderstatus WHEN 'F' THEN 'finished' ELSE 'open' END AS name
        FROM {orders}""",
    "crafts": """
        SELECT CAST(l_orderkey AS STRING) AS id, CAST(l_partkey AS STRING) AS recipe_id,
               CAST(l_suppkey AS STRING) AS user_id,
               CASE l_linestatus WHEN 'O' THEN 'cancelled' ELSE 'completed' END AS status, l_shipdate AS created_at
        FROM {lineitem}""",
    "recipes": """
        SELECT CAST(p_partkey AS STRING) AS id, p_name AS name
        FROM {part}""",
    "sinks_long": """
        SELECT l_shipdate AS created_at,
               l_returnflag AS name,
               split_part(p_name, ' ', 1) || ' $' || split_part(p_name, ' ', 2) AS craft_name,
               l_quantity AS amount,
               CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_quantity / 997.3 END AS currency_price
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "grant_tx": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id,
               CAST(l_suppkey AS STRING) AS user_id, 'GEM' AS token_id,
               CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS status,
               'grant' AS action, 'craft' AS source, l_quantity AS amount, l_shipdate AS created_at,
               CASE WHEN l_discount >= 0.05 THEN '{{"sourceString": "Craft"}}' ELSE '{{"sourceString": "Chest"}}' END AS extra
        FROM {lineitem}""",
    "pt_daily": """
        SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 997.3 AS avg_pt_price,
               avg(o_totalprice) / 1997.3 AS imputed_pt_cost, CAST(count(*) * 100 AS DOUBLE) AS pt_grants_raw,
               sum(CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) END) AS pt_sunk, sum(o_totalprice) / 97.3 AS spend_pt_usd
        FROM {orders} GROUP BY CAST(o_orderdate AS DATE)""",
    # ---------------- players (events / customer / nation / part) ----------------
    "token_tx": """
        SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS user_id, 'GEM' AS token_id,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN event_type = 'purchase' THEN 'sink' ELSE 'grant' END AS action,
               CASE WHEN event_type = 'click' THEN 'craft' ELSE 'game' END AS source,
               value / 1.07 AS amount, ts AS created_at,
               CASE WHEN CAST(get_json_object(props, '$.k') AS INT) < 15 THEN '{{"sourceString": "Craft"}}'
                    WHEN CAST(get_json_object(props, '$.k') AS INT) < 30 THEN '{{"sourceString": "band two.' || get_json_object(props, '$.k') || '"}}'
                    WHEN CAST(get_json_object(props, '$.k') AS INT) < 45 THEN '{{"sourceString": "band three"}}'
                    WHEN CAST(get_json_object(props, '$.k') AS INT) < 60 THEN '{{"sourceString": "Top Band.Daily"}}'
                    WHEN CAST(get_json_object(props, '$.k') AS INT) < 70 THEN '{{"sourceString": "band five"}}'
                    WHEN CAST(get_json_object(props, '$.k') AS INT) < 80 THEN '{{"sourceString": null}}'
                    WHEN CAST(get_json_object(props, '$.k') AS INT) < 90 THEN '{{"sourceString": {{"x": 1}}}}'
                    ELSE '{{"sourceString": "top band.extra"}}' END AS extra
        FROM {events}""",
    "users": """
        SELECT CAST(c_custkey AS STRING) AS id, c_name AS username,
               CASE WHEN c_nationkey = 0 THEN NULL ELSE n_name END AS country_code
        FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey""",
    "seg_crafts": """
        SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS user_id,
               get_json_object(props, '$.k') AS recipe_id,
               CASE WHEN value < 1 THEN 'cancelled' ELSE 'completed' END AS status, ts AS created_at
        FROM {events} WHERE event_type IN ('click', 'view')""",
    "seg_recipes": """
        SELECT CAST(p_partkey AS STRING) AS id, p_name AS name
        FROM {part}""",
    "dungeon_runs": """
        SELECT CAST(ts AS DATE) AS event_date,
               CASE event_type WHEN 'view' THEN 'PvP' WHEN 'signup' THEN 'Prestige' WHEN 'error' THEN 'Portal'
                    WHEN 'click' THEN 'Party' ELSE 'Town' END AS portal_type,
               CASE WHEN CAST(get_json_object(props, '$.k') AS INT) < 10 THEN 'Intro run'
                    WHEN CAST(get_json_object(props, '$.k') AS INT) < 20 THEN NULL
                    ELSE 'Mission ' || CAST(CAST(floor(CAST(get_json_object(props, '$.k') AS INT) / 10) AS BIGINT) AS STRING) END AS mission,
               CAST(CAST(floor(event_id / 3) AS BIGINT) AS STRING) AS instance_id,
               sha2(CAST(user_id AS STRING), 256) AS member_0,
               CASE WHEN value > 20 THEN sha2(CAST(user_id + 1 AS STRING), 256) END AS member_1,
               CASE WHEN value > 40 THEN sha2(CAST(user_id + 7 AS STRING), 256) END AS member_2,
               CASE WHEN value > 60 THEN sha2(CAST(user_id + 13 AS STRING), 256) END AS member_3,
               CASE WHEN value > 80 THEN sha2(CAST(user_id + 29 AS STRING), 256) END AS member_4,
               CASE WHEN value > 100 THEN sha2(CAST(user_id + 31 AS STRING), 256) END AS member_5
        FROM {events}""",
    "checkpoints": """
        SELECT sha2(CAST(user_id AS STRING), 256) AS user_id, CAST(ts AS DATE) AS checkpoint
        FROM {events} WHERE event_type IN ('signup', 'view')
        UNION ALL SELECT DISTINCT sha2(CAST(o_custkey AS STRING), 256), DATE '2024-01-20' FROM {orders} WHERE o_orderstatus = 'P'""",
    "cluster_history": """
        SELECT run_date, user_id, ga_id,
               CASE event_type WHEN 'view' THEN -1 WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS cluster,
               CASE event_type WHEN 'view' THEN 'F2P' WHEN 'click' THEN 'Casual' WHEN 'error' THEN 'Grinder'
                    WHEN 'purchase' THEN 'Collector' ELSE 'Unknown' END AS cluster_name
        FROM (SELECT run_date, user_id, ga_id, event_type,
                     row_number() OVER (PARTITION BY run_date, user_id ORDER BY n DESC, event_type) AS rn
              FROM (SELECT CASE WHEN CAST(ts AS DATE) < DATE '2024-01-16' THEN TIMESTAMP_NTZ '2024-01-15 06:00:00'
                                ELSE TIMESTAMP_NTZ '2024-01-30 06:00:00' END AS run_date,
                           CAST(user_id AS STRING) AS user_id, sha2(CAST(user_id AS STRING), 256) AS ga_id,
                           event_type, count(*) AS n
                    FROM {events} GROUP BY 1, 2, 3, 4) AS c) AS r
        WHERE rn = 1""",
    # ---------------- daily report facts (events, pre-aggregated per day) ----------------
    "kpi_revenue": """
        SELECT CAST(ts AS DATE) AS Date, 'item ' || get_json_object(props, '$.k') AS item_name,
               sum(value) AS revenue, count(DISTINCT user_id) AS Buyers, count(*) AS transactions
        FROM {events} WHERE event_type = 'purchase'
        GROUP BY 1, 2""",
    "kpi_dau": """
        SELECT CAST(ts AS DATE) AS Date, count(DISTINCT user_id) AS DAU, sum(value) / 60 AS hours_played,
               sum(value) / count(DISTINCT user_id) / 1.07 AS avg_time_per_player
        FROM {events} GROUP BY CAST(ts AS DATE)""",
    "kpi_dungeon": """
        SELECT CAST(ts AS DATE) AS Day,
               CASE event_type WHEN 'view' THEN 'PvP' WHEN 'click' THEN 'Party' ELSE 'Portal' END AS portalType,
               CASE WHEN CAST(get_json_object(props, '$.k') AS INT) < 5 THEN NULL
                    ELSE 'Mission ' || CAST(CAST(floor(CAST(get_json_object(props, '$.k') AS INT) / 10) AS BIGINT) AS STRING) END AS mission,
               count(DISTINCT user_id) AS Players, sum(value) AS dungeonUptime, sum(value) / 9.7 AS sandConsumed
        FROM {events} WHERE event_type IN ('view', 'click', 'error')
        GROUP BY 1, 2, 3""",
    "kpi_token": """
        SELECT CAST(ts AS DATE) AS Day, CASE WHEN event_type = 'purchase' THEN 'sink' ELSE 'grant' END AS action,
               CASE WHEN event_type = 'purchase' THEN 'Shop ' || CAST(CAST(floor(CAST(get_json_object(props, '$.k') AS INT) / 20) AS BIGINT) AS STRING)
                    ELSE 'grant: Mission ' || CAST(CAST(floor(CAST(get_json_object(props, '$.k') AS INT) / 10) AS BIGINT) AS STRING) || ' (daily)' END AS sourceString,
               sum(value) AS amount, count(DISTINCT user_id) AS users
        FROM {events} WHERE event_type IN ('purchase', 'signup', 'click')
        GROUP BY 1, 2, 3""",
    "kpi_craft": """
        SELECT CAST(ts AS DATE) AS Day, 'Recipe ' || CAST(CAST(floor(CAST(get_json_object(props, '$.k') AS INT) / 25) AS BIGINT) AS STRING) AS name,
               count(*) AS crafts, count(DISTINCT user_id) AS users
        FROM {events} WHERE event_type = 'click' GROUP BY 1, 2""",
    # ---------------- abuse ----------------
    "telemetry": """
        SELECT CAST(value AS STRING) AS raw_discrepancy, get_json_object(props, '$.k') AS current_discrepancy,
               CAST(user_id AS STRING) AS lifetime, CAST(event_id AS STRING) AS detected_count,
               '30' AS detected_window, event_id
        FROM {events}""",
    # ---------------- text ----------------
    "messages": """
        SELECT CAST(TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(conv_id AS INT), CAST(turn AS INT), 0) AS TIMESTAMP_NTZ) AS ts,
               role AS channel, 'user' || CAST(conv_id AS STRING) AS author, text AS content, conv_id, turn
        FROM {conversations}""",
    # ---------------- forecasting (orders) ----------------
    "policies": """
        SELECT o_orderstatus AS tenant, CAST(o_orderdate AS DATE) AS effective_date,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Yes' ELSE 'No' END AS is_renewal,
               o_totalprice / 1.07 AS written_premium, o_totalprice / 19.7 AS fees, o_orderkey AS policy_id
        FROM {orders}""",
}

_NAME_RE = re.compile(r"\{([a-z_]+)\}")


def deps(name: str) -> list[str]:
    return sorted(set(_NAME_RE.findall(BINDINGS[name])))


_BOUND: dict[tuple, DataFrame] = {}


def binding(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived input ``name`` as a lazy DataFrame over the driver tables
    (built once per session and directory; DataFrames are immutable plans)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BOUND:
        _BOUND[key] = _build(spark, sf_dir, name)
    return _BOUND[key]


def _build(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    args = {}
    for d in deps(name):
        args[d] = read_table(spark, d, sf_dir) if d in DRIVER_TABLES else binding(spark, sf_dir, d)
    return spark.sql(BINDINGS[name].strip(), **args)


def oracle_with(names, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause defining the given bindings (plus ``extra`` CTEs, in order) for DuckDB."""
    order: list[str] = []

    def visit(n):
        if n in DRIVER_TABLES or n in order:
            return
        for d in deps(n):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = []
    for n in order:
        sql = BINDINGS[n].strip().format(**{d: d for d in deps(n)})
        sql = sql.replace("get_json_object(", "json_extract_string(").replace("sha2(", "_sha2(").replace("TIMESTAMP_NTZ", "TIMESTAMP")
        sql = re.sub(r"_sha2\((.*?), 256\)", r"sha256(\1)", sql)
        sql = re.sub(r"make_interval\(0, 0, 0, 0, (.*?), (.*?), 0\)", r"(to_hours(\1) + to_minutes(\2))", sql)
        ctes.append(f"{n} AS ({sql})")
    for k, v in (extra or {}).items():
        ctes.append(f"{k} AS ({v})")
    return "WITH " + ",\n".join(ctes) + "\n"
