"""Threads wrapped in parts equal the wrap of the joined text."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerline.plans import catalog_text as C
from ledgerline.plans import text as X
from ledgerline.plans.chunking import chunk_threads


def rows(df):
    return sorted((r.channel or "", str(r.day), r.chunk_no, r.chunk) for r in df.collect())


def thread_messages(spark, seed, n=160):
    """Odd messages (empty, null, words longer than a line, hyphens) of three channels, one of which holds most."""
    rng = random.Random(seed)
    words = ["a", "bc", "well-known", "x" * 23, "one--two", "ab-" * 9, "def", "-", "e-mail's", "long" * 12]
    data = []
    for i in range(n):
        text = rng.choice([None, "", "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))]) if rng.random() < 0.4 else \
            " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        data.append((rng.choice(["hot", "hot", "hot", "cold", None]), i, 0, text))
    return (spark.createDataFrame(data, "channel string, conv_id int, turn int, clean_content string")
            .withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, conv_id)")))


@pytest.mark.parametrize("seed,width,parts", [(1, 20, 7), (2, 7, 40), (3, 50, 60), (4, 3, 25), (5, 400, 90), (6, 1, 5), (7, 11, 1), (8, 30, 120)])
def test_equals_the_wrap_of_the_whole_text(spark, seed, width, parts):
    m = thread_messages(spark, seed)
    assert rows(chunk_threads(m, width=width, parts=parts)) == rows(X.wrap(X.daily_documents(m), width=width))


def test_one_thread_that_holds_all_messages(spark):
    m = C.messages(spark, SF_SMALL).withColumn("channel", F.lit("all"))
    got = chunk_threads(m, parts=16)
    assert rows(got) == rows(X.wrap(X.daily_documents(m)))
    assert got.filter(F.length("chunk") > 3000).count() == 0


def test_blank_messages_and_empty_input(spark):
    m = thread_messages(spark, 9)
    assert chunk_threads(m.limit(0), width=10).count() == 0
    blank = m.withColumn("clean_content", F.when(F.col("conv_id") < 150, F.lit("")).otherwise(F.col("clean_content")))
    assert rows(chunk_threads(blank, width=20, parts=30)) == rows(X.wrap(X.daily_documents(blank), width=20))


def test_word_budget(spark):
    rng = random.Random(3)
    rows_ = [(c, i, t, " ".join(["w"] * rng.choice([0, 1, 2, 5, 9]))) for c in ("a", "b") for i in range(12) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows_, "channel string, conv_id int, turn int, clean_content string").repartition(5)
    for budget in (0, 1, 7, 40, 10_000):
        want, used = [], {}
        for r in sorted(rows_):
            used[r[0]] = used.get(r[0], 0) + len(r[3].split())
            if r[3] and used[r[0]] <= budget:
                want.append(r)
        got = X.within_budget(df, ["channel"], ["conv_id", "turn"], "clean_content", budget)
        assert sorted(tuple(r) for r in got.select("channel", "conv_id", "turn", "clean_content").collect()) == want
