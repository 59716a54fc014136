"""The daily report for every (tenant, run date) of a period in one job.

Each fact is read once and reduced to (tenant, keys, day).  The day before and the 7- and 30-day means are range
frames over the days of one key, so a period of any length costs the same passes as one date.  Rows of all
sections then share one layout and one bounded ranking per (tenant, date, section); every section keeps a stated number of rows."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.functions.exprs import clean_key, pct, safe_div
from ledgerline.session import cut_lineage

#: Rows kept per section (the report's lists hold 8 at most).
SECTION_ROWS = {"players_up": 8, "players_down": 5, "sand_movers": 8, "amount_movers": 8, "token_user_movers": 8, "sinks_today": 8,
                "sinks_change": 5, "craft_movers": 8, "craft_user_movers": 8}
FIGURES = ["value", "yday", "delta", "pct_change", "avg_7d", "avg_30d", "vs7_pct", "vs30_pct"]
LOOK_BACK = 30


def in_period(df: DataFrame, date_col: str, first: str, last: str) -> DataFrame:
    """The period and the days its means look back on."""
    return df.filter((F.col(date_col) >= F.date_sub(F.to_date(F.lit(first)), LOOK_BACK)) & (F.col(date_col) <= F.to_date(F.lit(last))))


def _frames(keys: Sequence[str]):
    w = Window.partitionBy(*keys).orderBy("_n")
    return {n: w.rangeBetween(-n, -1) for n in (1, 7, LOOK_BACK)}


def with_look_back(daily: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``m``, ``m_yday``, ``m_7``, ``m_30`` for every metric of a frame with one row per (keys, ``_day``): the day's total, the
    sum of the day before, and the means over the days present."""
    frames = _frames(keys)
    d = daily.withColumn("_n", F.datediff("_day", F.lit("1970-01-01").cast("date")))
    return d.select("*", *[e for m in metrics for e in (F.sum(m).over(frames[1]).alias(f"{m}_yday"), F.avg(m).over(frames[7]).alias(f"{m}_7"),
                                                        F.avg(m).over(frames[LOOK_BACK]).alias(f"{m}_30"))])


def figures(m: str) -> list[Column]:
    cur, y = F.coalesce(F.col(m), F.lit(0)).cast("double"), F.coalesce(F.col(f"{m}_yday"), F.lit(0)).cast("double")
    a7, a30 = F.col(f"{m}_7").cast("double"), F.col(f"{m}_30").cast("double")
    return [c.alias(n) for n, c in zip(FIGURES, [cur, y, cur - y, safe_div(cur - y, y) * 100, a7, a30, safe_div(cur - a7, a7) * 100, safe_div(cur - a30, a30) * 100])]


def _candidates(daily: DataFrame, by: Sequence[str], names: tuple[str | None, str], sections: dict, first: str) -> DataFrame:
    """One row per (tenant, date, section, key): a section is (metric, direction, condition); its rank is by the change
    (direction 1: largest first, -1: most negative first, 0: by the value itself)."""
    d = with_look_back(daily, [*by, *[n for n in names if n]], sorted({m for m, _, _ in sections.values()}))
    keep = F.col(names[1]).isNotNull() & (F.col(names[0]).isNotNull() if names[0] else F.lit(True))
    d = d.filter((F.col("_day") >= F.to_date(F.lit(first))) & keep)
    kind = F.col(names[0]).cast("string") if names[0] else F.lit(None).cast("string")

    def row(section, m, direction, cond):
        f = {n: c for n, c in zip(FIGURES, figures(m))}
        score = f["value"] if direction == 0 else f["delta"] * direction
        s = F.struct(F.lit(section).alias("section"), score.alias("score"), *f.values())
        return F.when(cond & (f["delta"] < 0) if direction < 0 else cond, s)

    rows = F.filter(F.array(*[row(s, m, direction, cond) for s, (m, direction, cond) in sections.items()]), lambda x: x.isNotNull())
    return d.select(*by, F.col("_day").alias("date"), kind.alias("kind"), F.col(names[1]).cast("string").alias("name"), F.explode(rows).alias("r")) \
            .select(*by, "date", "kind", "name", "r.*")


class Facts:
    """The five facts at day grain, each read once (``by``: tenant columns that all of them have)."""

    def __init__(self, rev: DataFrame, dau: DataFrame, dungeon: DataFrame, tokens: DataFrame, crafts: DataFrame, first: str, last: str, by: Sequence[str] = ()):
        self.first, self.last, self.by = first, last, list(by)

        def daily(df, date_col, keys, **aggs):
            grouped = in_period(df, date_col, first, last).groupBy(*by, *keys, F.col(date_col).alias("_day"))
            return cut_lineage(grouped.agg(*[f.alias(n) for n, f in aggs.items()]))

        self.items = daily(rev, "Date", ["item_name"], revenue=F.sum("revenue"), buyers=F.sum("Buyers"), transactions=F.sum("transactions"))
        self.active = daily(dau, "Date", [], dau=F.sum("DAU"), minutes=F.avg("avg_time_per_player"))
        self.dungeon = daily(dungeon, "Day", ["portalType", "mission"], players=F.sum("Players"), sand=F.sum("sandConsumed"))
        self.tokens = daily(tokens, "Day", ["action", "sourceString"], amount=F.sum("amount"), users=F.sum("users"))
        self.crafts = daily(crafts, "Day", ["name"], crafts=F.sum("crafts"), users=F.sum("users"))

    def spine(self) -> DataFrame:
        """Every (tenant, run date): a date without any row is reported too."""
        days = F.explode(F.sequence(F.to_date(F.lit(self.first)), F.to_date(F.lit(self.last)))).alias("date")
        if not self.by:
            return self.items.sparkSession.range(1).select(days)
        tenants = None
        for f in (self.items, self.active, self.dungeon, self.tokens, self.crafts):
            t = f.select(*self.by).distinct()
            tenants = t if tenants is None else tenants.unionByName(t)
        return tenants.distinct().select(*self.by, days)


def _left(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe keys, the right side's keys dropped."""
    cond = F.lit(True)
    r = b
    for i, k in enumerate(keys):
        r = r.withColumnRenamed(k, f"_r{i}")
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return a.join(r, cond, "left").drop(*[f"_r{i}" for i in range(len(keys))])


def kpi_days(facts: Facts) -> DataFrame:
    """The headline figures, one row per (tenant, run date); columns as ``report.kpis``, at six decimals."""
    by, spine = facts.by, facts.spine()
    rev = facts.items.groupBy(*by, "_day").agg(*[F.sum(c).alias(c) for c in ("revenue", "buyers", "transactions")])
    empty = spine.withColumnRenamed("date", "_day")

    def looked(daily, metric):
        rows = daily.unionByName(empty, allowMissingColumns=True).groupBy(*by, "_day").agg(*[F.max(c).alias(c) for c in daily.columns if c not in (*by, "_day")])
        return with_look_back(rows, by, [metric]).filter(F.col("_day") >= F.to_date(F.lit(facts.first))).drop("_n").withColumnRenamed("_day", "date")

    both = _left(looked(rev, "revenue"), looked(facts.active, "dau"), [*by, "date"])
    p = lambda a, c: F.round(pct(a, c) * 100, 6)
    zero = lambda c, z=0: F.coalesce(F.col(c), F.lit(z))
    rt, ry, dt = zero("revenue", 0.0), zero("revenue_yday", 0.0), zero("dau")
    c = F.col
    return both.select(
        *by, F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.round(rt, 6).alias("revenue_today"), p(rt, ry).alias("revenue_dod_pct"),
        p(rt, c("revenue_7")).alias("revenue_vs7d_avg_pct"), p(rt, c("revenue_30")).alias("revenue_vs30d_avg_pct"),
        zero("buyers").cast("long").alias("buyers"), zero("transactions").cast("long").alias("transactions"),
        F.round("revenue_7", 6).alias("revenue_avg_7d"), F.round("revenue_30", 6).alias("revenue_avg_30d"),
        dt.cast("long").alias("dau_today"), p(dt, c("dau_yday")).alias("dau_dod_pct"),
        p(dt, c("dau_7")).alias("dau_vs7d_avg_pct"), p(dt, c("dau_30")).alias("dau_vs30d_avg_pct"),
        F.round("dau_7", 6).alias("dau_avg_7d"), F.round("dau_30", 6).alias("dau_avg_30d"), F.round("minutes", 6).alias("avg_time_today_min"))


def section_days(facts: Facts) -> DataFrame:
    """(tenant, date, section, rank, kind, name, figures): the movers and sinks of every run date."""
    yes, sink = F.lit(True), F.col("action") == "sink"
    rows = _candidates(facts.dungeon, facts.by, ("portalType", "mission"), {
        "players_up": ("players", 1, yes), "players_down": ("players", -1, yes), "sand_movers": ("sand", 1, yes)}, facts.first)
    # an action's sources are keys of their own, so sinks by source are the rows of the action "sink"
    rows = rows.unionByName(_candidates(facts.tokens, facts.by, ("action", "sourceString"), {
        "amount_movers": ("amount", 1, yes), "token_user_movers": ("users", 1, yes), "sinks_today": ("amount", 0, sink), "sinks_change": ("amount", 1, sink)}, facts.first))
    rows = rows.unionByName(_candidates(facts.crafts, facts.by, (None, "name"), {
        "craft_movers": ("crafts", 1, yes), "craft_user_movers": ("users", 1, yes)}, facts.first))
    w = Window.partitionBy(*facts.by, "date", "section").orderBy(F.col("score").desc(), F.col("kind").asc_nulls_first(), F.col("name").asc_nulls_first())
    limits = F.create_map(*[F.lit(x) for kv in SECTION_ROWS.items() for x in kv])
    top = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(SECTION_ROWS.values()))     # a bound the ranking may use before its shuffle
    return top.filter(F.col("rank") <= limits[F.col("section")]).select(*facts.by, "date", "section", "rank", "kind", "name", *FIGURES)


def mission_days(facts: Facts) -> DataFrame:
    """(tenant, date, mission, players, tokens_granted, note): the mission with most tokens granted, linked on cleaned names; without
    a link the largest grant under its own name."""
    by, since = facts.by, F.col("_day") >= F.to_date(F.lit(facts.first))
    keys = [*by, F.col("_day").alias("date")]
    grants = facts.tokens.filter(since & (F.col("action") == "grant"))
    norm = grants.groupBy(*keys, clean_key("sourceString").alias("norm")).agg(F.sum("amount").alias("granted"))
    played = facts.dungeon.filter(since).groupBy(*keys, clean_key("mission").alias("norm")).agg(F.sum("players").alias("players"), F.min("mission").alias("mission"))
    linked = _left(norm.filter("norm IS NOT NULL"), played.filter("norm IS NOT NULL").withColumn("met", F.lit(True)), [*by, "date", "norm"]).filter("met")
    one = lambda prio, name, mission, players, granted, note: F.struct(
        F.lit(prio).alias("prio"), (-granted).alias("order"), name.alias("name"), mission.cast("string").alias("mission"),
        players.cast("long").alias("players"), granted.cast("long").alias("tokens_granted"), F.lit(note).cast("string").alias("note"))
    c = F.col
    rows = linked.select(*by, "date", one(0, c("norm"), F.coalesce("mission", "norm"), c("players"), c("granted"), None).alias("r"))
    raw = grants.filter("sourceString IS NOT NULL").select(*keys, one(
        1, c("sourceString"), c("sourceString"), F.lit(None), c("amount"), "no dungeon of this name today").alias("r"))
    return (rows.unionByName(raw).groupBy(*by, "date").agg(F.min("r").alias("r"))
            .select(*by, "date", "r.mission", "r.players", "r.tokens_granted", "r.note"))


def top_items(facts: Facts) -> DataFrame:
    """(tenant, date, item, revenue): the best seller (ties: the larger name)."""
    d = facts.items.filter((F.col("_day") >= F.to_date(F.lit(facts.first))) & F.col("item_name").isNotNull() & F.col("revenue").isNotNull())
    return (d.groupBy(*facts.by, F.col("_day").alias("date")).agg(F.max(F.struct("revenue", "item_name")).alias("r"))
            .select(*facts.by, "date", F.col("r.item_name").alias("item"), F.col("r.revenue").cast("double").alias("revenue")))


# The report's interface (fixed names): group -> list -> (section, name of kind, name of name, name of the measure).
LAYOUT = {
    "gameplay": {"players_up": ("players_up", "portalType", "mission", "Players"), "players_down": ("players_down", "portalType", "mission", "Players"),
                 "sand_movers": ("sand_movers", "portalType", "mission", "sandConsumed")},
    "tokens": {"amount_movers": ("amount_movers", "action", "sourceString", "amount"), "user_movers": ("token_user_movers", "action", "sourceString", "users"),
               "sinks_today": ("sinks_today", None, "sourceString", "amount"), "sinks_change": ("sinks_change", None, "sourceString", "amount")},
    "crafting": {"craft_movers": ("craft_movers", None, "name", "crafts"), "user_movers": ("craft_user_movers", None, "name", "users")},
}


def context_days(facts: Facts) -> DataFrame:
    """(tenant, date, context): one JSON document per (tenant, run date).  Figures have six decimals; a missing figure is null."""
    by = facts.by
    dec = lambda c: c.cast("decimal(38,6)")
    rows = section_days(facts).groupBy(*by, F.date_format("date", "yyyy-MM-dd").alias("date")).agg(
        F.sort_array(F.collect_list(F.struct("section", "rank", "kind", "name", *FIGURES))).alias("rows"))        # 66 rows a date at most
    def records(section, kind, name, measure):
        def rec(x):
            fields = [x["kind"].alias(kind)] if kind else []
            fields += [x["name"].alias(name), dec(x["value"]).alias(measure)]
            if section != "sinks_today":
                fields += [dec(x[f]).alias(f) for f in ("delta", "pct_change")]
                fields += [dec(x["avg_7d"]).alias(f"{measure}_7d_avg"), dec(x["avg_30d"]).alias(f"{measure}_30d_avg")]
                fields += [dec(x[f]).alias(f) for f in ("vs7_pct", "vs30_pct")]
            return F.struct(*fields)
        return F.transform(F.filter(F.coalesce("rows", F.array()), lambda x: x["section"] == section), rec)

    kp = kpi_days(facts)
    text = lambda f: f.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    m = text(mission_days(facts)).select(*by, "date", F.struct("mission", "players", "tokens_granted", "note").alias("m"))
    t = text(top_items(facts)).select(*by, "date", F.struct("item", dec(F.col("revenue")).alias("revenue")).alias("t"))
    j = kp
    for part in (rows, m, t):
        j = _left(j, part, [*by, "date"])
    whole = {f.name for f in kp.schema.fields if f.dataType.typeName() == "double"}
    kpis = F.struct(*[(dec(F.col(c)) if c in whole else F.col(c)).alias(c) for c in kp.columns if c not in by])
    groups = {g: [records(*spec).alias(n) for n, spec in items.items()] for g, items in LAYOUT.items()}
    groups["gameplay"].append(F.col("m").alias("mission_insight"))
    doc = F.struct("date", kpis.alias("kpis"), F.struct(F.col("t").alias("top_item")).alias("drivers"), *[F.struct(*fields).alias(g) for g, fields in groups.items()])
    return j.select(*by, "date", F.to_json(doc, {"ignoreNullFields": "false"}).alias("context"))
