"""Golden fixtures for the semantic traps: tiny literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import exprs as X
from ledgerline.operators.reshape import union_padded, unpivot_nonnull
from ledgerline.operators.stats import histogram
from ledgerline.plans import report as R
from ledgerline.plans import token as T


def test_like_underscore_is_a_wildcard_and_dollar_is_literal(spark):
    df = spark.createDataFrame([("Extract",), ("Extract_X",), ("ExtractX",), ("Extract $GEM from x",), ("Extract GEM",)], "s string")
    got = {r.s for r in df.filter(F.col("s").like("%Extract_%")).collect()}
    assert got == {"Extract_X", "ExtractX", "Extract $GEM from x", "Extract GEM"}
    assert [r.s for r in df.filter(F.col("s").like("%Extract $GEM%")).collect()] == ["Extract $GEM from x"]


def test_safe_and_strict_divide(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (4.0, 2.0)], "a double, b double")
    assert [r.q for r in df.select(X.safe_div("a", "b").alias("q")).collect()] == [None, None, 2.0]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        spark.createDataFrame([(1, 0)], "a int, b int").select(X.strict_div("a", "b")).collect()


def test_scalar_json_nulls_objects_and_json_null(spark):
    df = spark.createDataFrame([('{"s": "x"}',), ('{"s": {"a": 1}}',), ('{"s": null}',), ('{"s": [1]}',), ("not json",)], "j string")
    assert [r.v for r in df.select(X.scalar_json("j", "$.s").alias("v")).collect()] == ["x", None, None, None, None]


def test_clean_key_is_case_sensitive_before_lowering(spark):
    df = spark.createDataFrame([("grant: Mission 3 (daily)",), ("Grant: Mission 3",), ("  a  b ",), (None,)], "s string")
    assert [r.k for r in df.select(X.clean_key("s").alias("k")).collect()] == ["mission 3", "grant: mission 3", "a b", None]


def test_clean_message_order_and_unicode_space(spark):
    rows = [("hi <@123> <@!45> see http://x.y/z and www.a.b", "hi see and"),
            ("**bold** _it_ ~s~ `c`", "bold it s c"),
            ("<:my_emoji:123> ok <a:anim:9>", "ok <a:anim:9>"),
            ("smile \U0001F600 end", "smile end"),
            ("a  b\n\tc  ", "a b c")]
    df = spark.createDataFrame(rows, "s string, want string")
    out = df.select(X.clean_message("s").alias("got"), "want").collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_unpivot_drops_null_members(spark):
    df = spark.createDataFrame([("i1", "a", None, "b"), ("i2", None, None, None)], "id string, m0 string, m1 string, m2 string")
    out = unpivot_nonnull(df, ["id"], ["m0", "m1", "m2"]).collect()
    assert sorted((r.id, r.member) for r in out) == [("i1", "a"), ("i1", "b")]


def test_union_padded_fills_only_the_padded_side(spark):
    old = spark.createDataFrame([(dt.date(2025, 5, 14), 1.0)], "day date, total_cost double")
    new = spark.createDataFrame([(dt.date(2025, 5, 14), 2.0, None)], "day date, total_cost double, fee double")
    out = sorted(union_padded(old, new).collect(), key=lambda r: r.total_cost)
    assert [r.fee for r in out] == [0.0, None]


def test_histogram_max_in_last_bin_and_constant_column(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    h = {r.bin: r["count"] for r in histogram(df, "x", bins=2).collect()}
    assert h == {0: 1, 1: 2}
    c = histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", bins=4).collect()
    # every bin is returned, empty ones with 0
    assert sorted((r.bin, r["count"], r.lo, r.hi) for r in c) == [(0, 0, 2.5, 2.75), (1, 0, 2.75, 3.0), (2, 2, 3.0, 3.25), (3, 0, 3.25, 3.5)]


def _base(spark, rows):
    cols = list(T.BASE_COLUMNS)
    schema = ", ".join(f"{c} {'date' if c == 'day' else 'double'}" for c in cols)
    data = [tuple(r.get(c) for c in cols) for r in rows]
    return spark.createDataFrame(data, schema)


def test_blended_short_window_is_eight_rows_and_rolling_matches_point(spark):
    rows = [{"day": dt.date(2025, 1, 1) + dt.timedelta(days=i), "spend_chest_usd": float(i + 1), "grant_chest": 1.0,
             "avg_token_price": 1.0} for i in range(10)]
    out = {r.day: r for r in T.token_efficiency(_base(spark, rows)).collect()}
    last = out[dt.date(2025, 1, 10)]
    assert last.blended_efficiency_rolling_7 == pytest.approx(sum(range(3, 11)) / 8)     # 8 rows: days 3..10
    assert last.chest_efficiency_rolling_7 == pytest.approx(sum(range(4, 11)) / 7)       # 7 rows
    first = out[dt.date(2025, 1, 1)]
    assert first.chest_efficiency_rolling_7 == pytest.approx(first.chest_efficiency)     # 1-row frame = point ratio


def test_null_days_sort_first_and_duplicate_days_are_kept(spark):
    rows = [{"day": None, "spend_chest_usd": 100.0, "grant_chest": 1.0, "avg_token_price": 1.0},
            {"day": dt.date(2025, 5, 14), "spend_chest_usd": 1.0, "grant_chest": 1.0, "avg_token_price": 1.0, "total_cost": 1.0},
            {"day": dt.date(2025, 5, 14), "spend_chest_usd": 3.0, "grant_chest": 1.0, "avg_token_price": 1.0, "total_cost": 2.0}]
    out = T.token_efficiency(_base(spark, rows)).collect()
    assert len(out) == 3
    by_cost = {r.total_cost: r for r in out}
    assert by_cost[None].chest_efficiency_rolling_7 == pytest.approx(100.0)     # NULL day first
    assert by_cost[2.0].chest_efficiency_rolling_7 == pytest.approx(104.0 / 3)  # ordered after total_cost 1.0
    deduped = T.token_efficiency(_base(spark, rows), dedupe_day=True).collect()
    assert len(deduped) == 2


def test_movers_drop_null_keys_and_absent_keys(spark):
    rd = dt.date(2024, 1, 30)
    rows = [(rd, "a", 5.0), (rd, None, 9.0), (rd - dt.timedelta(days=1), "a", 2.0), (rd - dt.timedelta(days=1), "b", 7.0),
            (rd - dt.timedelta(days=3), "a", 4.0)]
    df = spark.createDataFrame(rows, "Day date, k string, m double")
    out = R.change_vs_prior(df, "Day", ["k"], "m", "2024-01-30").collect()
    assert [r.k for r in out] == ["a"]
    a = out[0]
    assert (a.m, a.m_yday, a.delta) == (5.0, 2.0, 3.0)
    assert a.m_7d_avg == pytest.approx(3.0)     # days present only: (2 + 4) / 2
    assert a.pct_change == pytest.approx(150.0)


def test_first_last_tie_break_is_deterministic(spark):
    from ledgerline.operators.aggregates import first_last
    ts = dt.datetime(2025, 3, 28)
    df = spark.createDataFrame([("u", ts, "B"), ("u", ts, "A"), ("u", ts + dt.timedelta(days=1), "C")], "user_id string, run_date timestamp, c string")
    r = first_last(df, "user_id", "c", "run_date").collect()[0]
    assert (r.first_value, r.last_value) == ("A", "C")
