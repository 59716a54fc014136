"""Registered daily-report queries (Spark) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.exprs import clean_key, fmt_int, fmt_money, fmt_pct, pct
from ledgerline.operators.aggregates import window_avg
from ledgerline.operators.filters import between_days, scan_window, slices
from ledgerline.operators.joins import left_on_expr
from ledgerline.operators.ordering import decliners, dedup, head_records, top1
from ledgerline.plans import bindings as B
from ledgerline.plans import report as R
from ledgerline.plans import report_days as RD_
from ledgerline.plans.registry import register

RD = B.RUN_DATE
D = f"DATE '{RD}'"
KPI_TABLES = ["kpi_revenue", "kpi_dau", "kpi_dungeon", "kpi_token", "kpi_craft"]


def ow(extra: dict | None = None) -> str:
    return B.oracle_with(KPI_TABLES, extra)


def b(spark, d, n):
    return B.binding(spark, d, n)


# --------------------------------------------------------------------------- SQL helpers

def movers_sql(tbl: str, date: str, keys: list[str], metric: str, top_n: int | None, where: str = "TRUE") -> str:
    ks = ", ".join(keys)
    nn = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    body = f"""SELECT {ks}, CAST(cur AS DOUBLE) AS {metric}, CAST(y AS DOUBLE) AS {metric}_yday, CAST(cur - y AS DOUBLE) AS delta,
      (cur - y) / nullif(y, 0) * 100 AS pct_change, a7 AS {metric}_7d_avg, a30 AS {metric}_30d_avg,
      (cur - a7) / nullif(a7, 0) * 100 AS vs7_pct, (cur - a30) / nullif(a30, 0) * 100 AS vs30_pct
    FROM (SELECT {ks}, max(CASE WHEN _day = {D} THEN 1 ELSE 0 END) AS _present,
                 sum(CASE WHEN _day = {D} THEN coalesce(_v, 0) END) AS cur,
                 coalesce(sum(CASE WHEN _day = {D} - 1 THEN coalesce(_v, 0) END), 0) AS y,
                 avg(CASE WHEN _day >= {D} - 7 AND _day < {D} THEN _v END) AS a7,
                 avg(CASE WHEN _day >= {D} - 30 AND _day < {D} THEN _v END) AS a30
          FROM (SELECT {ks}, {date} AS _day, sum({metric}) AS _v FROM {tbl}
                WHERE {nn} AND ({where}) AND {date} >= {D} - 40 AND {date} <= {D} GROUP BY {ks}, {date}) AS dly
          GROUP BY {ks}) AS m
    WHERE _present = 1"""
    if top_n:
        body += f"\n    ORDER BY delta DESC NULLS LAST, " + ", ".join(f"{k} NULLS FIRST" for k in keys) + f" LIMIT {top_n}"
    return body


def movers_dbl(metric: str) -> list[str]:
    return [metric, f"{metric}_yday", "delta", "pct_change", f"{metric}_7d_avg", f"{metric}_30d_avg", "vs7_pct", "vs30_pct"]


def p100(a: str, c: str, digits: int = 2) -> str:
    return f"round(({a} - {c}) / nullif({c}, 0) * 100, {digits})"


KPI_SQL = f"""
SELECT '{RD}' AS date, round(rt, 2) AS revenue_today, {p100('rt', 'ry')} AS revenue_dod_pct,
  {p100('rt', 'r7')} AS revenue_vs7d_avg_pct, {p100('rt', 'r30')} AS revenue_vs30d_avg_pct,
  CAST(buyers AS BIGINT) AS buyers, CAST(transactions AS BIGINT) AS transactions,
  round(r7, 2) AS revenue_avg_7d, round(r30, 2) AS revenue_avg_30d,
  CAST(dt AS BIGINT) AS dau_today, {p100('dt', 'dy')} AS dau_dod_pct, {p100('dt', 'd7')} AS dau_vs7d_avg_pct,
  {p100('dt', 'd30')} AS dau_vs30d_avg_pct, round(d7, 2) AS dau_avg_7d, round(d30, 2) AS dau_avg_30d,
  round(dm, 2) AS avg_time_today_min
FROM (SELECT coalesce(sum(CASE WHEN _day = {D} THEN _v END), 0) AS rt,
             coalesce(sum(CASE WHEN _day = {D} THEN _b END), 0) AS buyers,
             coalesce(sum(CASE WHEN _day = {D} THEN _t END), 0) AS transactions,
             coalesce(sum(CASE WHEN _day = {D} - 1 THEN _v END), 0) AS ry,
             avg(CASE WHEN _day >= {D} - 7 AND _day < {D} THEN _v END) AS r7,
             avg(CASE WHEN _day >= {D} - 30 AND _day < {D} THEN _v END) AS r30
      FROM (SELECT Date AS _day, sum(revenue) AS _v, sum(Buyers) AS _b, sum(transactions) AS _t FROM kpi_revenue
            WHERE Date >= {D} - 40 AND Date <= {D} GROUP BY Date) AS r) AS r1,
     (SELECT coalesce(sum(CASE WHEN _day = {D} THEN _v END), 0) AS dt,
             sum(CASE WHEN _day = {D} - 1 THEN _v END) AS dy,
             avg(CASE WHEN _day >= {D} - 7 AND _day < {D} THEN _v END) AS d7,
             avg(CASE WHEN _day >= {D} - 30 AND _day < {D} THEN _v END) AS d30,
             max(CASE WHEN _day = {D} THEN _m END) AS dm
      FROM (SELECT Date AS _day, sum(DAU) AS _v, avg(avg_time_per_player) AS _m FROM kpi_dau
            WHERE Date >= {D} - 40 AND Date <= {D} GROUP BY Date) AS u) AS u1"""
KPI_DBL = ["revenue_today", "revenue_dod_pct", "revenue_vs7d_avg_pct", "revenue_vs30d_avg_pct", "revenue_avg_7d",
           "revenue_avg_30d", "dau_dod_pct", "dau_vs7d_avg_pct", "dau_vs30d_avg_pct", "dau_avg_7d", "dau_avg_30d",
           "avg_time_today_min"]


def clean_sql(x: str) -> str:
    s = f"regexp_replace(CAST({x} AS VARCHAR), '\\(.*?\\)', '', 'g')"
    s = f"regexp_replace({s}, 'grant[:\\- ]*', '', 'g')"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    return f"lower(trim({s}))"


def kpis(spark, d):
    return R.kpis(b(spark, d, "kpi_revenue"), b(spark, d, "kpi_dau"), RD)


# --------------------------------------------------------------------------- registrations

@register("rep_kpis", sql=ow() + KPI_SQL, dbl=KPI_DBL, dates=())
def q_kpis(spark, d):
    """Revenue and DAU today, DoD %, vs 7/30-day means, buyers, transactions, minutes."""
    return kpis(spark, d)


@register("rep_movers", sql=ow() + movers_sql("kpi_dungeon", "Day", ["portalType", "mission"], "Players", 10),
          dbl=movers_dbl("Players"), dates=())
def q_movers(spark, d):
    return R.change_vs_prior(b(spark, d, "kpi_dungeon"), "Day", ["portalType", "mission"], "Players", RD, top_n=10)


@register("join_composite_left", sql=ow() + movers_sql("kpi_dungeon", "Day", ["portalType", "mission"], "sandConsumed", 10),
          dbl=movers_dbl("sandConsumed"), dates=())
def q_sand(spark, d):
    """today / yesterday / 7-day / 30-day joined on (portalType, mission) — one conditional-aggregate pass."""
    return R.change_vs_prior(b(spark, d, "kpi_dungeon"), "Day", ["portalType", "mission"], "sandConsumed", RD, top_n=10)


@register("topn_movers", sql=ow() + movers_sql("kpi_token", "Day", ["action", "sourceString"], "amount", 15),
          dbl=movers_dbl("amount"), dates=())
def q_topn(spark, d):
    return R.change_vs_prior(b(spark, d, "kpi_token"), "Day", ["action", "sourceString"], "amount", RD, top_n=15)


@register("bottomn_movers",
          sql=ow({"mv": movers_sql("kpi_dungeon", "Day", ["portalType", "mission"], "Players", None)})
          + "SELECT * FROM mv WHERE delta < 0 ORDER BY delta ASC, portalType NULLS FIRST, mission NULLS FIRST LIMIT 5",
          dbl=movers_dbl("Players"), dates=())
def q_bottomn(spark, d):
    """True bottom-5 decliners over all keys (``from_top=10`` reproduces the source)."""
    mv = R.change_vs_prior(b(spark, d, "kpi_dungeon"), "Day", ["portalType", "mission"], "Players", RD)
    return decliners(mv, 5, ["portalType", "mission"])


@register("rep_sinks", sql=ow() + movers_sql("kpi_token", "Day", ["sourceString"], "amount", 5, where="action = 'sink'"),
          dbl=movers_dbl("amount"), dates=())
def q_sinks(spark, d):
    return R.sinks_change(b(spark, d, "kpi_token"), RD, top_n=5)


@register("rep_sinks_today", sql=ow() + f"SELECT sourceString, sum(amount) AS amount FROM kpi_token WHERE Day = {D} "
          "AND action = 'sink' AND sourceString IS NOT NULL GROUP BY 1", dbl=["amount"], dates=())
def q_sinks_today(spark, d):
    return R.sinks_today(b(spark, d, "kpi_token"), RD)


LINK_SQL = f"""
SELECT mission, players, tokens_granted, note FROM (
  SELECT 0 AS _prio, g.tokens_granted AS _o, g.mission_norm, coalesce(p.mission, g.mission_norm) AS mission,
         CAST(p.players AS BIGINT) AS players, CAST(trunc(g.tokens_granted) AS BIGINT) AS tokens_granted, CAST(NULL AS VARCHAR) AS note
  FROM (SELECT {clean_sql('sourceString')} AS mission_norm, sum(amount) AS tokens_granted FROM kpi_token
        WHERE Day = {D} AND action = 'grant' GROUP BY 1) AS g
  JOIN (SELECT {clean_sql('mission')} AS mission_norm, sum(Players) AS players, min(mission) AS mission FROM kpi_dungeon
        WHERE Day = {D} GROUP BY 1) AS p ON g.mission_norm = p.mission_norm
  WHERE g.mission_norm IS NOT NULL
  UNION ALL
  SELECT 1, sum(amount), sourceString, sourceString, CAST(NULL AS BIGINT), CAST(trunc(sum(amount)) AS BIGINT), 'no dungeon of this name today'
  FROM kpi_token WHERE Day = {D} AND action = 'grant' AND sourceString IS NOT NULL GROUP BY sourceString
) AS u ORDER BY _prio, _o DESC, mission_norm LIMIT 1"""


@register("rep_mission_link", sql=ow() + LINK_SQL, dates=())
def q_link(spark, d):
    return R.mission_insight(b(spark, d, "kpi_token"), b(spark, d, "kpi_dungeon"), RD)


@register("join_inner_normalised", sql=ow() + f"""
SELECT g.mission_norm, g.tokens_granted, p.players FROM
  (SELECT {clean_sql('sourceString')} AS mission_norm, sum(amount) AS tokens_granted FROM kpi_token
   WHERE action = 'grant' GROUP BY 1) AS g
  JOIN (SELECT {clean_sql('mission')} AS mission_norm, CAST(sum(Players) AS BIGINT) AS players FROM kpi_dungeon GROUP BY 1) AS p
  ON g.mission_norm = p.mission_norm""", dbl=["tokens_granted"], dates=())
def q_inner_norm(spark, d):
    """Grants joined to dungeon players on the cleaned mission text (all days)."""
    g = b(spark, d, "kpi_token").filter(F.col("action") == "grant").groupBy(clean_key("sourceString").alias("mission_norm")) \
        .agg(F.sum("amount").alias("tokens_granted"))
    p = b(spark, d, "kpi_dungeon").groupBy(clean_key("mission").alias("mission_norm")).agg(F.sum("Players").alias("players"))
    return g.join(p, "mission_norm", "inner")


@register("fn_clean_key", sql=ow() + f"SELECT DISTINCT sourceString, {clean_sql('sourceString')} AS key FROM kpi_token",
          dates=())
def q_clean_key(spark, d):
    return b(spark, d, "kpi_token").select("sourceString", clean_key("sourceString").alias("key")).distinct()


# --------------------------------------------------------------------------- the report over a period

FIRST = R.run_dates(RD, 30)[-1]
FD = f"DATE '{FIRST}'"


def facts(spark, d, first: str = FIRST, last: str = RD) -> RD_.Facts:
    return RD_.Facts(*[b(spark, d, n) for n in ("kpi_revenue", "kpi_dau", "kpi_dungeon", "kpi_token", "kpi_craft")], first, last)


def look_sql(tbl: str, kind: str, name: str, metric: str) -> str:
    """Totals per key and day with the days before joined to them."""
    return f"""SELECT a.kind, a.name, a.d, coalesce(any_value(a.v), 0) AS cur, coalesce(sum(p.v) FILTER (p.d = a.d - 1), 0) AS y,
        avg(p.v) FILTER (p.d >= a.d - 7) AS a7, avg(p.v) AS a30
      FROM (SELECT {kind} AS kind, {name} AS name, Day AS d, sum({metric}) AS v FROM {tbl} GROUP BY 1, 2, 3) AS a
      LEFT JOIN (SELECT {kind} AS kind, {name} AS name, Day AS d, sum({metric}) AS v FROM {tbl} GROUP BY 1, 2, 3) AS p
        ON a.kind = p.kind AND a.name = p.name AND p.d < a.d AND p.d >= a.d - 30
      WHERE a.d BETWEEN {FD} AND {D} AND a.kind IS NOT NULL AND a.name IS NOT NULL GROUP BY 1, 2, 3"""


SECTIONS_SQL = [("players_up", "l_players", "cur - y", "TRUE"), ("players_down", "l_players", "y - cur", "cur < y"), ("sand_movers", "l_sand", "cur - y", "TRUE"),
                ("amount_movers", "l_amount", "cur - y", "TRUE"), ("token_user_movers", "l_users", "cur - y", "TRUE"),
                ("sinks_today", "l_amount", "cur", "kind = 'sink'"), ("sinks_change", "l_amount", "cur - y", "kind = 'sink'"),
                ("craft_movers", "l_crafts", "cur - y", "TRUE"), ("craft_user_movers", "l_makers", "cur - y", "TRUE")]
PERIOD = {
    "l_players": look_sql("kpi_dungeon", "portalType", "mission", "Players"), "l_sand": look_sql("kpi_dungeon", "portalType", "mission", "sandConsumed"),
    "l_amount": look_sql("kpi_token", "action", "sourceString", "amount"), "l_users": look_sql("kpi_token", "action", "sourceString", "users"),
    "l_crafts": look_sql("kpi_craft", "''", "name", "crafts"), "l_makers": look_sql("kpi_craft", "''", "name", "users"),
    "sections": f"""SELECT d AS date, section, rank, nullif(kind, '') AS kind, name, CAST(cur AS DOUBLE) AS value, CAST(y AS DOUBLE) AS yday,
        CAST(cur - y AS DOUBLE) AS delta, (cur - y) / nullif(y, 0) * 100 AS pct_change, a7 AS avg_7d, a30 AS avg_30d,
        (cur - a7) / nullif(a7, 0) * 100 AS vs7_pct, (cur - a30) / nullif(a30, 0) * 100 AS vs30_pct
      FROM (SELECT *, CAST(row_number() OVER (PARTITION BY d, section ORDER BY score DESC, kind, name) AS INTEGER) AS rank FROM ("""
    + " UNION ALL ".join(f"SELECT '{n}' AS section, *, CAST({score} AS DOUBLE) AS score FROM {t} WHERE {cond}" for n, t, score, cond in SECTIONS_SQL)
    + ") AS u) AS r WHERE rank <= CASE WHEN section IN ('players_down', 'sinks_change') THEN 5 ELSE 8 END",
    "spine": f"SELECT CAST(unnest(generate_series({FD}, {D}, INTERVAL 1 DAY)) AS DATE) AS d",
    "period_kpis": f"""SELECT strftime(d, '%Y-%m-%d') AS date, round(rt, 6) AS revenue_today, {p100('rt', 'ry', 6)} AS revenue_dod_pct,
        {p100('rt', 'r7', 6)} AS revenue_vs7d_avg_pct, {p100('rt', 'r30', 6)} AS revenue_vs30d_avg_pct, CAST(buyers AS BIGINT) AS buyers,
        CAST(transactions AS BIGINT) AS transactions, round(r7, 6) AS revenue_avg_7d, round(r30, 6) AS revenue_avg_30d, CAST(dt AS BIGINT) AS dau_today,
        {p100('dt', 'dy', 6)} AS dau_dod_pct, {p100('dt', 'd7', 6)} AS dau_vs7d_avg_pct, {p100('dt', 'd30', 6)} AS dau_vs30d_avg_pct, round(d7, 6) AS dau_avg_7d,
        round(d30, 6) AS dau_avg_30d, round(dm, 6) AS avg_time_today_min
      FROM (SELECT d, coalesce(sum(v) FILTER (day = d), 0) AS rt, coalesce(sum(n) FILTER (day = d), 0) AS buyers, coalesce(sum(t) FILTER (day = d), 0) AS transactions,
                   coalesce(sum(v) FILTER (day = d - 1), 0) AS ry, avg(v) FILTER (day >= d - 7 AND day < d) AS r7, avg(v) FILTER (day < d) AS r30
            FROM spine LEFT JOIN (SELECT Date AS day, sum(revenue) AS v, sum(Buyers) AS n, sum(transactions) AS t FROM kpi_revenue GROUP BY 1) AS x
              ON day BETWEEN d - 30 AND d GROUP BY d) AS r1
      JOIN (SELECT d, coalesce(sum(v) FILTER (day = d), 0) AS dt, sum(v) FILTER (day = d - 1) AS dy, max(m) FILTER (day = d) AS dm,
                   avg(v) FILTER (day >= d - 7 AND day < d) AS d7, avg(v) FILTER (day < d) AS d30
            FROM spine LEFT JOIN (SELECT Date AS day, sum(DAU) AS v, avg(avg_time_per_player) AS m FROM kpi_dau GROUP BY 1) AS x
              ON day BETWEEN d - 30 AND d GROUP BY d) AS u1 USING (d)""",
    "period_items": f"""SELECT Date AS d, max_by(item_name, (revenue, item_name)) AS item, CAST(max(revenue) AS DOUBLE) AS revenue
      FROM (SELECT Date, item_name, sum(revenue) AS revenue FROM kpi_revenue WHERE item_name IS NOT NULL GROUP BY 1, 2) AS x GROUP BY 1""",
    "period_grants": f"SELECT Day AS d, sourceString AS src, {clean_sql('sourceString')} AS norm, sum(amount) AS amount FROM kpi_token WHERE action = 'grant' GROUP BY 1, 2, 3",
    "period_missions": f"""SELECT d, mission, players, tokens_granted, note FROM (
        SELECT *, row_number() OVER (PARTITION BY d ORDER BY prio, o DESC, norm) AS rn FROM (
          SELECT 0 AS prio, g.d, g.amount AS o, g.norm, p.mission, CAST(p.players AS BIGINT) AS players, CAST(trunc(g.amount) AS BIGINT) AS tokens_granted, CAST(NULL AS VARCHAR) AS note
          FROM (SELECT d, norm, sum(amount) AS amount FROM period_grants GROUP BY 1, 2) AS g
          JOIN (SELECT Day AS d, {clean_sql('mission')} AS norm, sum(Players) AS players, min(mission) AS mission FROM kpi_dungeon GROUP BY 1, 2) AS p
            ON g.d = p.d AND g.norm = p.norm
          UNION ALL SELECT 1, d, amount, src, src, CAST(NULL AS BIGINT), CAST(trunc(amount) AS BIGINT), 'no dungeon of this name today' FROM period_grants WHERE src IS NOT NULL
        ) AS u) AS r WHERE rn = 1""",
}


def context_sql() -> str:
    dec = lambda x: f"CAST({x} AS DECIMAL(38,6))"

    def records(section, kind, name, measure):
        fields = ([f"'{kind}': kind"] if kind else []) + [f"'{name}': name", f"'{measure}': {dec('value')}"]
        if section != "sinks_today":
            fields += [f"'{f}': {dec(f)}" for f in ("delta", "pct_change")] + [f"'{measure}_7d_avg': {dec('avg_7d')}", f"'{measure}_30d_avg': {dec('avg_30d')}"]
            fields += [f"'{f}': {dec(f)}" for f in ("vs7_pct", "vs30_pct")]
        return "coalesce(list({" + ", ".join(fields) + f"}} ORDER BY rank) FILTER (section = '{section}'), [])"

    lists = {f"{g}_{n}": records(*spec) for g, items in RD_.LAYOUT.items() for n, spec in items.items()}
    kpi_cols = ["date", "revenue_today", "revenue_dod_pct", "revenue_vs7d_avg_pct", "revenue_vs30d_avg_pct", "buyers", "transactions", "revenue_avg_7d",
                "revenue_avg_30d", "dau_today", "dau_dod_pct", "dau_vs7d_avg_pct", "dau_vs30d_avg_pct", "dau_avg_7d", "dau_avg_30d", "avg_time_today_min"]
    kpi = ", ".join(f"'{c}': {dec('k.' + c) if c in KPI_DBL else 'k.' + c}" for c in kpi_cols)
    insight = "CASE WHEN m.d IS NOT NULL THEN {'mission': m.mission, 'players': m.players, 'tokens_granted': m.tokens_granted, 'note': m.note} END"
    groups = []
    for g, items in RD_.LAYOUT.items():
        fields = [f"'{n}': coalesce(l.{g}_{n}, [])" for n in items] + ([f"'mission_insight': {insight}"] if g == "gameplay" else [])
        groups.append(f"'{g}': {{" + ", ".join(fields) + "}")
    return (f"""SELECT k.date, CAST(to_json({{'date': k.date, 'kpis': {{{kpi}}},
      'drivers': {{'top_item': CASE WHEN t.d IS NOT NULL THEN {{'item': t.item, 'revenue': {dec('t.revenue')}}} END}}, {', '.join(groups)}}}) AS VARCHAR) AS context
    FROM period_kpis k LEFT JOIN period_items t ON k.date = strftime(t.d, '%Y-%m-%d') LEFT JOIN period_missions m ON k.date = strftime(m.d, '%Y-%m-%d')
    LEFT JOIN (SELECT date, {', '.join(f'{v} AS {c}' for c, v in lists.items())} FROM sections GROUP BY date) AS l ON k.date = strftime(l.date, '%Y-%m-%d')""")


@register("rep_sections", sql=ow(PERIOD) + "SELECT * FROM sections", dbl=RD_.FIGURES, dates=("date",), digits=6)
def q_sections(spark, d):
    """Movers and sinks of 30 run dates in one job, bounded lists per (date, section)."""
    return RD_.section_days(facts(spark, d))


@register("rep_kpi_days", sql=ow(PERIOD) + "SELECT * FROM period_kpis", dbl=KPI_DBL, dates=(), digits=6)
def q_kpi_days(spark, d):
    """The headline figures of 30 run dates in one job."""
    return RD_.kpi_days(facts(spark, d))


@register("rep_context", sql=ow(PERIOD) + context_sql(), round_result=False, dates=())
def q_context(spark, d):
    """The whole report as one compact JSON document per run date (lists of 8 records at most), 30 dates in one job."""
    return RD_.context_days(facts(spark, d))


PROMPT_SQL = "'" + R.PROMPT_HEAD.replace("'", "''").replace("%s", "' || date || '", 1).replace("%s", "' || context") 


@register("rep_prompt", sql=ow({**PERIOD, "ctx": context_sql()}) + f"SELECT date, {PROMPT_SQL} AS prompt FROM ctx", round_result=False, dates=())
def q_prompt(spark, d):
    return R.prompt_text(RD_.context_days(facts(spark, d)))


def _num_sql(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'None')"


BULLETS_SQL = ow({"k": KPI_SQL}) + f"""
SELECT date, substr(concat_ws(chr(10), 'Figures of ' || date,
  'Sales ' || format('{{:,.0f}}', revenue_today) || ' USD in ' || format('{{:,}}', transactions) || ' payments by ' || format('{{:,}}', buyers)
    || ' people; day before ' || {_num_sql('revenue_dod_pct')} || ' %, week ' || {_num_sql('revenue_vs7d_avg_pct')} || ' %',
  'Active players ' || format('{{:,}}', dau_today) || ', ' || {_num_sql('avg_time_today_min')} || ' minutes each; day before '
    || {_num_sql('dau_dod_pct')} || ' %, week ' || {_num_sql('dau_vs7d_avg_pct')} || ' %'), 1, 4000) AS summary FROM k"""


@register("rep_bullets", sql=BULLETS_SQL, dates=())
def q_bullets(spark, d):
    """Deterministic digest (first 4,000 characters) used when no generated text returns."""
    return R.bullets(kpis(spark, d))


@register("fn_truncate", sql=BULLETS_SQL, dates=())
def q_truncate(spark, d):
    return R.bullets(kpis(spark, d))


@register("scan_date_window", sql=ow() + f"SELECT * FROM kpi_dau WHERE Date BETWEEN {D} - 40 AND {D}",
          dbl=["hours_played", "avg_time_per_player"], dates=("Date",))
def q_scan_window(spark, d):
    """Inclusive [start, today] window with bound parameters (40-day look-back)."""
    import datetime as dt
    start = (dt.date.fromisoformat(RD) - dt.timedelta(days=40)).isoformat()
    return scan_window(b(spark, d, "kpi_dau"), "Date", F.to_date(F.lit(start)), F.to_date(F.lit(RD)))


@register("slice_today_yday", sql=ow() + f"""SELECT Date, item_name, revenue, Date = {D} AS is_today, Date = {D} - 1 AS is_yday,
    Date >= {D} - 7 AND Date < {D} AS in_7d, Date >= {D} - 30 AND Date < {D} AS in_30d FROM kpi_revenue""",
          dbl=["revenue"], dates=("Date",))
def q_slices(spark, d):
    return slices(b(spark, d, "kpi_revenue").select("Date", "item_name", "revenue"), "Date", RD)


@register("filter_half_open", sql=ow() + f"SELECT * FROM kpi_revenue WHERE Date >= {D} - 7 AND Date < {D}",
          dbl=["revenue"], dates=("Date",))
def q_half_open(spark, d):
    import datetime as dt
    start = (dt.date.fromisoformat(RD) - dt.timedelta(days=7)).isoformat()
    return between_days(b(spark, d, "kpi_revenue"), "Date", F.to_date(F.lit(start)), F.to_date(F.lit(RD)))


@register("agg_two_level", sql=ow() + f"""SELECT portalType, avg(_d) AS Players_avg FROM
    (SELECT portalType, Day, sum(Players) AS _d FROM kpi_dungeon WHERE Day >= {D} - 7 AND Day < {D} GROUP BY 1, 2) AS t
    GROUP BY 1""", dbl=["Players_avg"], dates=())
def q_two_level(spark, d):
    """Sum per (key, day), then mean over the days present (7-day window)."""
    import datetime as dt
    start = (dt.date.fromisoformat(RD) - dt.timedelta(days=7)).isoformat()
    return window_avg(b(spark, d, "kpi_dungeon"), "Day", "Players", F.to_date(F.lit(start)), F.to_date(F.lit(RD)),
                      keys=["portalType"])


@register("top1", sql=ow() + f"""SELECT item_name, revenue FROM (SELECT item_name, sum(revenue) AS revenue FROM kpi_revenue
    WHERE Date = {D} GROUP BY 1) AS t ORDER BY revenue DESC, item_name DESC LIMIT 1""", dbl=["revenue"], dates=())
def q_top1(spark, d):
    """Best seller today (ties -> larger name)."""
    rev = b(spark, d, "kpi_revenue").filter(F.col("Date") == F.to_date(F.lit(RD)))
    return top1(rev.groupBy("item_name").agg(F.sum("revenue").alias("revenue")), [], "revenue", ["item_name", "revenue"])


@register("win_top1_per_key", sql=ow() + """SELECT Date, item_name, revenue FROM (SELECT Date, item_name, revenue,
    row_number() OVER (PARTITION BY Date ORDER BY revenue DESC, item_name DESC) AS rn FROM kpi_revenue) AS t WHERE rn = 1""",
          dbl=["revenue"], dates=("Date",))
def q_top1_key(spark, d):
    """Best item per day (row_number with a full tie-break)."""
    from ledgerline.operators.windows import top_k
    return top_k(b(spark, d, "kpi_revenue").select("Date", "item_name", "revenue"), ["Date"],
                 [F.col("revenue").desc(), F.col("item_name").desc()], k=1)


@register("limit_records", sql=ow({"mv": movers_sql("kpi_token", "Day", ["action", "sourceString"], "users", 15)})
          + "SELECT * FROM mv ORDER BY delta DESC NULLS LAST, action, sourceString LIMIT 8", dbl=movers_dbl("users"), dates=())
def q_limit_records(spark, d):
    mv = R.change_vs_prior(b(spark, d, "kpi_token"), "Day", ["action", "sourceString"], "users", RD, top_n=15)
    return head_records(mv, [F.col("delta").desc_nulls_last(), F.col("action"), F.col("sourceString")], 8)


@register("dedup_keep_first", sql=ow() + f"""SELECT mission_norm, mission FROM (SELECT {clean_sql('mission')} AS mission_norm, mission,
    row_number() OVER (PARTITION BY {clean_sql('mission')} ORDER BY mission) AS rn FROM kpi_dungeon
    WHERE Day = {D} AND mission IS NOT NULL) AS t WHERE rn = 1""", dates=())
def q_dedup(spark, d):
    """First readable mission name per cleaned key (explicit order, not arbitrary)."""
    gp = b(spark, d, "kpi_dungeon").filter((F.col("Day") == F.to_date(F.lit(RD))) & F.col("mission").isNotNull())
    return dedup(gp.select(clean_key("mission").alias("mission_norm"), "mission"), ["mission_norm"], [F.col("mission")])


@register("fn_pct", sql=ow() + """SELECT a.Date, a.DAU, CAST(p.DAU AS DOUBLE) AS DAU_prev, (a.DAU - p.DAU) / nullif(p.DAU, 0) AS dod
    FROM kpi_dau a LEFT JOIN kpi_dau p ON a.Date - 1 = p.Date""", dbl=["dod"], dates=("Date",))
def q_pct(spark, d):
    """Day-over-day change as a fraction; NULL on a missing or zero prior day."""
    dau = b(spark, d, "kpi_dau").select("Date", "DAU")
    prev = dau.select(F.col("Date").alias("_k"), F.col("DAU").alias("DAU_prev"))
    j = left_on_expr(dau, prev, F.date_sub("Date", 1), "_k")
    return j.select("Date", "DAU", F.col("DAU_prev").cast("double").alias("DAU_prev"), pct("DAU", "DAU_prev").alias("dod"))


@register("join_left_expr_key", sql=ow() + """SELECT a.Date, a.DAU, CAST(p.DAU AS DOUBLE) AS DAU_prev
    FROM kpi_dau a LEFT JOIN kpi_dau p ON a.Date - 1 = p.Date""", dates=("Date",))
def q_left_expr(spark, d):
    """Key computed on one side (previous day) then an equi left join."""
    dau = b(spark, d, "kpi_dau").select("Date", "DAU")
    prev = dau.select(F.col("Date").alias("_k"), F.col("DAU").alias("DAU_prev"))
    return left_on_expr(dau, prev, F.date_sub("Date", 1), "_k").select("Date", "DAU", F.col("DAU_prev").cast("double").alias("DAU_prev"))


@register("fn_format", sql=ow() + """SELECT Date, printf('$%.1fM', sum(revenue) * 1000 / 1e6) AS revenue_m,
    printf('%.1f%%', sum(Buyers) / sum(transactions) * 100) AS buyer_share, format('{:,.0f}', sum(revenue) * 1000) AS revenue_units
    FROM kpi_revenue GROUP BY Date""", dates=("Date",))
def q_format(spark, d):
    """``$1.2M``, ``12.3%`` and ``1,234`` labels per day."""
    rev = b(spark, d, "kpi_revenue").groupBy("Date").agg((F.sum("revenue") * 1000).alias("r"),
                                                         (F.sum("Buyers") / F.sum("transactions")).alias("s"))
    return rev.select("Date", fmt_money("r").alias("revenue_m"), fmt_pct("s").alias("buyer_share"),
                      fmt_int("r").alias("revenue_units"))
