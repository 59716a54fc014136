import random
import re

import pytest

from ledgerline.llm import decontaminate as D, line_dedup as L


def brute_leaks(text, items, overlap=0.8, shingle=5):
    out = set()
    words = D.tokens(text)
    for i, q in items:
        parts = D.parts_of(q or "", None)
        if not parts:
            continue
        ok = True
        for p in parts:
            k = min(shingle, len(p))
            want = {tuple(p[j:j + k]) for j in range(len(p) - k + 1)}
            have = {tuple(words[j:j + k]) for j in range(len(words) - k + 1)}
            ok &= len(want & have) / len(want) >= overlap
        if ok:
            out.add(i)
    return out


def prose(rng, n, vocab=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocab}" + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.mark.parametrize("shard_words", [2_000_000, 300])
def test_leaks(spark, shard_words):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(12, 150))) for i in range(40)] + [(99, ""), (98, None), (97, "One two three. Yes"), (0, "extra item with the same id and its own words here. Fine")]
    texts = [prose(rng, rng.randint(0, 600)) for _ in range(60)] + [None, "", "..."]
    for k in range(30):
        i, q = items[k]
        host = prose(rng, rng.randint(0, 500)).split()
        at = rng.randint(0, len(host))
        edited = q.upper() if k % 3 else re.sub(r"\s+", "\n  ", q)
        texts.append(" ".join(host[:at]) + " " + edited + " " + " ".join(host[at:]))
    texts.append("well, one TWO three. yes indeed")
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, number double")
    bench = spark.createDataFrame(items + items[:3], "item_id bigint, text string")
    got = {}
    for r in D.leaks(docs, bench, ["doc_id"], shard_words=shard_words).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    want = {i: w for i, t in enumerate(texts) if (w := brute_leaks(t, items))}
    assert got == want
    assert len(want) >= 30
    left = {r.doc_id for r in D.clean(docs, bench, shard_words=shard_words).collect()}
    assert left == set(range(len(texts))) - set(want)


def test_search_equals_plain_scores():
    import math
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(5, 60), 80), "") for i in range(70)]
    segs = [(i, x, s) for i, q, a in items for x, s in D.segments_of(D.parts_of(q, a), 64, 5, 0.8)]
    owner, exact, segs = map(list, zip(*segs))
    df = {}
    for s in segs:
        for w in set(s):
            df[w] = df.get(w, 0) + 1
    mean = sum(map(len, segs)) / len(segs)
    index = D.Index(items, df, len(segs), mean, 64, 5, 0.2)

    def score(words, s):
        imp = {w: math.log1p((len(segs) - df[w] + .5) / (df[w] + .5)) * s.count(w) * (D.K1 + 1) / (s.count(w) + D.K1 * (1 - D.B + D.B * len(s) / mean)) for w in set(s)}
        return sum(imp[w] for w in set(words) if w in imp) / sum(imp.values())
    for _ in range(20):
        words = D.tokens(prose(rng, 100, 80))
        for threshold in (0.2, 0.5):
            assert index.search([words], threshold)[0] == {i for i, x, s in zip(owner, exact, segs) if score(words, s) >= (1 - 1e-9 if x else threshold)}


def index_of(items):
    segs = [w for _, q, a in items for _, w in D.segments_of(D.parts_of(q, a), 64, 5, 0.8)]
    df = {}
    for s in segs:
        for w in set(s):
            df[w] = df.get(w, 0) + 1
    return D.Index(items, df, len(segs), sum(map(len, segs)) / len(segs), 64, 5)


def test_retrieval_by_search_alone(monkeypatch):
    """Without the search nothing is found: verification sees retrieved items only."""
    item = [(1, "one two three four five six seven", "eight nine ten eleven twelve")]
    text = "one two three four five six seven then eight nine ten eleven twelve"
    assert [n for n, _, _ in index_of(item).leaks([text], 0.6, 0.8)[0]] == [1]
    monkeypatch.setattr(D.Tier, "search", lambda *a: (D.np.zeros(0, int),) * 2)
    assert index_of(item).leaks([text], 0.6, 0.8) == [[]]


def test_recall_of_all_items_that_verify():
    """Against every item verified without retrieval, on edited and scattered copies among common words."""
    rng = random.Random(15)
    items = [(i, prose(rng, rng.randint(5, 90), 3000), prose(rng, rng.randint(2, 30), 3000)) for i in range(80)]
    index = index_of(items)
    want = got = 0
    for i, q, a in items:
        far = " ".join([prose(rng, 200, 3000), a, prose(rng, 300, 3000), q])
        words = q.split()
        if len(words) > 30:                                    # one word in thirty is another
            words[rng.randrange(len(words))] = "edited"
        for text in (far, " ".join(words) + " " + a):
            have = D.tokens(text)
            for n, parts in index.parts.items():
                if min(len(p & set(zip(*(have[j:] for j in range(len(next(iter(p)))))))) / len(p) for p in parts) >= 0.8:
                    want += 1
                    got += n in {m for m, _, _ in index.leaks([text], 0.6, 0.8)[0]}
    assert want >= 150 and got == want


def test_question_and_answer_far_apart():
    """The question at the top and the answer at the end, or the question in two places: each passage holds too little."""
    rng = random.Random(14)
    words = lambda n: " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(n))
    items = [(i, words(rng.randint(1, 40)), words(rng.randint(1, 40))) for i in range(60)] + [(60, words(150), words(3))]
    index = index_of(items)
    for i, q, a in items:
        far = " ".join([q, words(600), a])
        cut = q.split()
        half = len(cut) // 2 + 2
        pieces = " ".join([a, words(500), *cut[:half], words(500), *cut[max(half - 4, 0):], words(300)])
        for text in (far, pieces):
            assert [n for n, _, _ in index.leaks([text], 0.6, 0.8)[0]] == [i]
        assert index.leaks([" ".join([q, words(600)])], 0.6, 0.8) == [[]]


def test_leaks_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert D.leaks(docs, bench, ["doc_id"]).count() == 0
    assert D.clean(docs, bench).count() == 1
    assert D.leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], bench.schema), ["doc_id"]).count() == 0


# ---------------------------------------------------------------- line dedup
def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, n_lines int")


def test_shared_passage_removed(spark):
    rng = random.Random(6)
    line = lambda n: " ".join(f"x{rng.randint(0, 10**6)}" for _ in range(n))
    passage = "\n".join(line(n) for n in (20, 3, 18, 5, 30))
    single = line(60)
    own = ["\n".join(line(rng.randint(3, 25)) for _ in range(rng.randint(1, 8))) for _ in range(30)]
    texts = own[:10] + [f"{t}\n{passage}\n{u}" for t, u in zip(own[10:20], own[20:])] + [f"{line(12)} z\n{single}", single, passage, None, "", "\n\n\n\n"]
    got = {r.doc_id: r for r in L.dedup_lines(rows_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i in range(10):
        assert got[i].n_repeated == 0 and got[i].text == texts[i]
    for i in range(10, 20):
        assert got[i].n_repeated >= 5
    assert passage in got[10].text and got[10].n_removed == 0
    for i in range(11, 20):
        assert got[i].text == own[i] + "\n" + own[i + 10] and got[i].n_removed == 5
    assert got[20].n_repeated == 1 and got[20].n_removed == 0
    assert got[21].n_removed == 1 and got[21].text == ""
    assert got[22].n_removed == 5
    assert got[23].text is None and got[24].text == "" and got[25].n_removed == 0


def brute_runs(spark, lines):
    from pyspark.sql import functions as F
    row = spark.createDataFrame([("\n".join(lines),)], "t string").select(L.runs_of(L.lines_of(F.col("t")), 2, 16, 8, 50).alias("r")).first()
    return {tuple(lines[x.at:x.at + x.n]) for x in row.r}


def test_runs_are_shift_resistant(spark):
    rng = random.Random(7)
    passage = [" ".join(f"k{rng.randint(0, 10**6)}" for _ in range(n)) for n in (17, 4, 6, 20, 2, 40)]
    a = brute_runs(spark, ["one", "two words"] + passage)
    b = brute_runs(spark, ["else " * 5] * 3 + passage + ["tail"])
    shared = {x for run in a & b for x in run}
    assert set(passage) <= shared


def test_repeat_inside_one_text(spark):
    block = "alpha beta gamma delta epsilon zeta eta theta\n" + "b " * 20
    got = L.dedup_lines(rows_of(spark, [block + "\nmiddle\n" + block])).first()
    assert got.n_removed == 2 and got.text == block + "\nmiddle"


def brute_kept(texts, min_words=8, alone_words=50):
    """Kept lines of every text: a line goes if a repeated run over it first stands in an earlier text or, apart, in its own."""
    split = [[] if t is None else t.split("\n") for t in texts]
    first, gone = {}, [set() for _ in texts]
    for d, lines in enumerate(split):
        for at in range(len(lines)):
            for n in range(1, len(lines) - at + 1):
                run = tuple(lines[at:at + n])
                if sum(len(x.split()) for x in run) >= (min_words if n > 1 else alone_words):
                    e, where = first.setdefault(run, (d, at))
                    if e < d or where + n <= at:
                        gone[d].update(range(at, at + n))
    return [[x for i, x in enumerate(lines) if i not in g] for lines, g in zip(split, gone)]


def test_passage_in_a_text_that_has_a_copy(spark):
    rng = random.Random(12)
    line = lambda n: " ".join(f"c{rng.randint(0, 10**6)}" for _ in range(n))
    passages = [[line(20), line(18), line(25)], [line(60)], [line(17), line(16)]]
    texts = []
    for p in passages:
        host = [line(20), line(17)], [line(19), line(30)]
        texts += ["\n".join([line(20)] + p + [line(20)]), "\n".join(host[0] + p + host[1])]
        texts += [texts[-1], texts[-1] + "\n" + line(20)]        # an exact and a near copy of the text that holds the passage
    got = [r.text for r in L.dedup_lines(rows_of(spark, texts)).orderBy("doc_id").collect()]
    want = ["\n".join(k) for k in brute_kept(texts)]
    assert got == want
    for k, p in enumerate(passages):
        assert not set(p) & set(got[4 * k + 1].split("\n")) and set(p) <= set(got[4 * k].split("\n"))


def test_short_line_passages(spark):
    """Passages of short lines (verse, lists, code) go wherever they stand, as brute force over all runs says."""
    rng = random.Random(13)
    line = lambda n: " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(n))
    texts = []
    for k in range(60):
        lengths = [rng.randint(1, 4) for _ in range(5)] if k % 3 == 0 else [rng.choice([0, 2, 3, 9]) for _ in range(8)] if k % 3 == 1 else [rng.randint(6, 15) for _ in range(5)]
        passage = [line(n) for n in lengths]
        for _ in range(2):
            texts.append("\n".join([line(rng.randint(1, 9)) for _ in range(rng.randint(0, 4))] + passage + [line(rng.randint(1, 9)) for _ in range(rng.randint(0, 4))]))
    few = ["a b", "", "c", "d e f g h", "i j k l m n o p q"]                       # texts over few lines, with periods and blanks
    texts += ["\n".join(rng.choice(few) for _ in range(rng.randint(1, 14))) for _ in range(60)] + [line(55) + "\n" + line(2)]
    got = [r.text for r in L.dedup_lines(rows_of(spark, texts)).orderBy("doc_id").collect()]
    want = brute_kept(texts)
    assert got == ["\n".join(k) for k in want]
    assert sum(len(t.split("\n")) for t in texts) - sum(map(len, want)) > 300


def test_lines_empty(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_lines_without_boundaries(spark):
    """Lines that recur with a short period have no boundary of their own; chunks are bounded all the same."""
    rng = random.Random(8)
    passage = "\n".join(" ".join(f"p{rng.randint(0, 10**6)}" for _ in range(n)) for n in (25, 4, 30))
    texts = ["\n" * 30_000 + passage, "head\n" + "x y z\n" * 5_000 + passage, "a\nb\n" * 3_000]
    got = {r.doc_id: r for r in L.dedup_lines(rows_of(spark, texts)).collect()}
    assert got[0].n_lines == 30_003 and passage in got[0].text
    assert passage not in got[1].text and got[1].n_removed >= 3
    assert max(len(r) for r in brute_runs(spark, [""] * 500 + ["word " * 9])) <= 65


def test_clean_keeps_clashing_columns(spark):
    text = "what is the name of the tall grey tower by the river bank. it is the old mill tower of the town"
    docs = spark.createDataFrame([(1, "nothing of that kind in here", 5, "r", 2), (2, text, 6, None, 3)],
                                 "doc_id bigint, text string, twin int, row string, _twin int")
    bench = spark.createDataFrame([(1, text, 9)], "item_id bigint, text string, twin int")
    got = D.clean(docs, bench)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "nothing of that kind in here", 5, "r", 2)]
