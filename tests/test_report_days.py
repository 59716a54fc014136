"""The report of a period equals the reports of its dates; tenants are kept apart."""

import json

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerline.plans import bindings as B
from ledgerline.plans import report as R
from ledgerline.plans import report_days as P

TABLES = ("kpi_revenue", "kpi_dau", "kpi_dungeon", "kpi_token", "kpi_craft")


def near(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(a)))


def test_each_date_equals_a_single_run(spark):
    tables = [B.binding(spark, SF_SMALL, t) for t in TABLES]
    dates = R.run_dates(B.RUN_DATE, 6)
    facts = P.Facts(*tables, dates[-1], dates[0])
    kpis = {r.date: r for r in P.kpi_days(facts).collect()}
    lists = {}
    for r in P.section_days(facts).orderBy("rank").collect():
        lists.setdefault((str(r.date), r.section), []).append(r)
    missions = {str(r.date): r for r in P.mission_days(facts).collect()}
    assert sorted(kpis) == sorted(dates)
    for date in dates[::2]:
        one = R.kpis(tables[0], tables[1], date).first()
        assert all(kpis[date][c] == v or abs(kpis[date][c] - v) < 0.0051 for c, v in one.asDict().items())      # at two places there
        for section, df, keys, metric, n in (("players_up", tables[2], ["portalType", "mission"], "Players", 8),
                                             ("token_user_movers", tables[3], ["action", "sourceString"], "users", 8)):
            want = R.change_vs_prior(df, "Day", keys, metric, date, top_n=n).orderBy(F.col("delta").desc(), *keys).collect()
            got = lists.get((date, section), [])
            assert [(r.kind, r.name) for r in got] == [(w[keys[0]], w[keys[1]]) for w in want]
            for g, w in zip(got, want):
                assert near(g.value, w[metric]) and near(g.delta, w.delta) and near(g.pct_change, w.pct_change)
                assert near(g.avg_7d, w[f"{metric}_7d_avg"]) and near(g.vs30_pct, w.vs30_pct)
        want = R.mission_insight(tables[3], tables[2], date).first()
        assert (missions[date].mission, missions[date].players, missions[date].tokens_granted) == (want.mission, want.players, want.tokens_granted)


def test_tenants_and_empty_dates(spark, tmp_path):
    tables = [B.binding(spark, SF_SMALL, t) for t in TABLES]
    date = {"kpi_revenue": "Date", "kpi_dau": "Date"}
    first = R.run_dates(B.RUN_DATE, 2)[-1]
    two = [t.withColumn("tenant", F.lit("a")).unionByName(t.withColumn("tenant", F.lit(None).cast("string")).filter(F.col(date.get(n, "Day")) < F.to_date(F.lit(first))))
           for n, t in zip(TABLES, tables)]
    for n, t in zip(TABLES, two):
        t.write.parquet(str(tmp_path / n))
    two = [spark.read.parquet(str(tmp_path / n)) for n in TABLES]
    rows = {(r.tenant, r.date): json.loads(r.context) for r in P.context_days(P.Facts(*two, first, B.RUN_DATE, by=["tenant"])).collect()}
    single = {r.date: json.loads(r.context) for r in P.context_days(P.Facts(*tables, first, B.RUN_DATE)).collect()}
    assert len(rows) == 4
    for d, doc in single.items():
        assert rows[("a", d)] == doc
        empty = rows[(None, d)]                      # a tenant without rows in the period is reported with its means
        assert empty["kpis"]["revenue_today"] == 0 and empty["gameplay"]["players_up"] == [] and empty["drivers"]["top_item"] is None
        assert empty["kpis"]["revenue_avg_30d"] is not None
    assert {len(doc["tokens"]["amount_movers"]) for doc in single.values()} <= set(range(9))
    assert all(set(doc) == {"date", "kpis", "drivers", "gameplay", "tokens", "crafting"} for doc in single.values())
