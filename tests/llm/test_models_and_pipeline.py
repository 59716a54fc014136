import random

import numpy as np
import pytest

import corpus_pipeline
from ledgerline.llm import quality as Q, toxicity as T


# ---------------------------------------------------------------- toxicity
def test_windows_cover_and_overlap():
    for n in (0, 1, 8, 9, 32, 33, 500):
        w = T.windows_of(n, 0)
        assert set(w[w >= 0].tolist()) == set(range(n))
        for a, b in zip(w, w[1:]):
            assert b[0] == a[0] + T.STRIDE and T.STRIDE < T.WINDOW


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(12)]
    stats = {k: (rng.standard_normal(T.STAT_ROWS) * 0.3).astype(np.float32) for k in ("words", "runs")}
    stats |= {k: np.ones(T.STAT_ROWS, bool) for k in ("known_words", "known_runs")}
    x = T.inputs(words, stats)
    p = {k: v.astype(np.float64) for k, v in T.new_parameters(1).items()}
    ids = np.full((3, T.WINDOW), -1)
    for r, n in enumerate((32, 7, 1)):
        ids[r, :n] = rng.integers(0, 12, n)
    y, weight = np.array([1, 0, 1]), np.full(3, 1 / 3)
    got = T.gradients(p, x, ids, y, weight)

    def loss(q):
        z = T.window_logits(q, T.word_gates(q, x), ids).astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    for k in ("o", "a", "A", "Wf", "Wb", "Uf", "Ub", "cf"):
        flat = np.abs(got[k]).reshape(-1)
        i = int(flat.argmax())
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k].reshape(-1)[i] += 1e-2
        down[k].reshape(-1)[i] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - got[k].reshape(-1)[i]) < 0.05 * max(flat[i], 1e-2), k


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "to", "li", "mo"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_learns_planted_words(spark):
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = prose(rng, rng.randint(5, 120)).split()
        if toxic:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(["vilest", "scumbag", "zorrk" + rng.choice(["an", "er", "li"])]))
        docs.append((i, " ".join(words), 1.0))
        labels.append((i, int(toxic)))
    docs += [(2000, "", 0.0), (2001, None, 0.0), (None, "vilest " + prose(rng, 3000), 0.0), (5, docs[5][1], 1.0)]
    rows = T.toxicity(spark.createDataFrame(docs, "doc_id bigint, text string, score double"),
                      spark.createDataFrame(labels + [(7000, 1), (1, None), (None, 1)], "doc_id bigint, toxic int"), ["doc_id"]).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    import zlib
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in held)
    assert right / len(held) > 0.95


def test_one_class_or_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in T.toxicity(docs, none, ["doc_id"]).collect()} == {0.0}
    assert T.toxicity(docs.limit(0), none, ["doc_id"]).count() == 0


# ---------------------------------------------------------------- quality
def quality_rows(rng):
    docs, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = prose(rng, rng.randint(60, 120)).split()
        text = " ".join(w + "###" for w in words) if bad else " ".join(words)
        docs.append((i, text, rng.choice(["en", None]), rng.choice(["s1", "s2", None]), 7.0))
        if i % 2 == 0:
            labels.append((i, int(not bad)))
    return docs, labels


def test_quality_keeps_clean_documents(spark):
    docs, labels = quality_rows(random.Random(1))
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n double")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int")
    for r in Q.judged(d, lab).collect():
        assert r.kept == (r.doc_id % 5 != 0)
    kept = Q.keep_good(d, lab)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(400) if i % 5]


def test_posteriors_shrink(spark):
    docs, labels = quality_rows(random.Random(2))
    docs = [(i, t, "en", "good" if i % 5 else "bad", 1.0) for i, t, *_ in docs] + [(1000, "a few plain words here", "en", "sparse", 1.0)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n double")
    sites, _ = Q.fit(d, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    t = {r.host: r for r in sites.table.collect()}
    assert t["good"].s / t["good"].n > 0.95 > 0.05 > t["bad"].s / t["bad"].n
    rows = {r.doc_id: r for r in Q.judged(d, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert abs(rows[1000].host_posterior - sites.share) < 1e-6            # without its own evidence the host is at the prior


def test_quality_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    lab = spark.createDataFrame([], "doc_id bigint, quality int")
    assert Q.judged(d, lab).count() == 0 and Q.keep_good(d, lab).count() == 0


# ---------------------------------------------------------------- pipeline
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, sf), f"t{i}")
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == names
        if i == 1:
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert len(ids) == len(set(ids))
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    rows = sorted(docs.collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


def test_repeated_training_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in (1, 2, 3, 4)] * 40, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)] * 3, "doc_id bigint, toxic int")
    rows = T.training_rows(docs, labels, "doc_id", "text", "toxic", 700, 5)
    assert rows.count() == rows.select("id").distinct().count() > 0


def plain_forward(p, x):
    """One window's logit, word by word and gate by gate, in double precision."""
    p = {k: v.astype(np.float64) for k, v in p.items()}
    h = T.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    word, known, runs, weight, fixed = x
    inp = [np.concatenate([p["words"][word[i]] * known[i], sum(p["runs"][r] * w for r, w in zip(runs[i], weight[i])), fixed[i]]) for i in range(len(word))]

    def read(order, k):
        state, out = np.zeros(h), {}
        for i in order:
            gate = inp[i] @ p[f"W{k}"] + p[f"c{k}"]
            z, r = sig(gate[:h] + state @ p[f"U{k}"][:, :h]), sig(gate[h:2 * h] + state @ p[f"U{k}"][:, h:2 * h])
            c = np.tanh(gate[2 * h:] + (r * state) @ p[f"U{k}"][:, 2 * h:])
            state = z * state + (1 - z) * c
            out[i] = state
        return out

    there, back = read(range(len(inp)), "f"), read(range(len(inp) - 1, -1, -1), "b")
    states = [np.concatenate([there[i], back[i]]) for i in range(len(inp))]
    e = np.exp([np.tanh(s @ p["A"]) @ p["a"] for s in states])
    return sum(w * s for w, s in zip(e / e.sum(), states)) @ p["o"] + p["b"][0]


def random_model(seed):
    rng = np.random.default_rng(seed)
    p = T.new_parameters(seed)
    p["words"] = (rng.standard_normal(p["words"].shape) * 0.5).astype(np.float32)
    stats = {k: (rng.standard_normal(T.STAT_ROWS) * 0.5).astype(np.float32) for k in ("words", "runs")}
    return {"p": p, "stats": stats | {k: rng.random(T.STAT_ROWS) < 0.7 for k in ("known_words", "known_runs")}}


def test_scorer_equals_plain_forward_pass():
    """Every window of texts of many lengths, scored one by one."""
    rng, model = random.Random(7), random_model(3)
    texts = [prose(rng, n) for n in (1, 2, 31, 32, 33, 56, 57, 300)] + ["one", "Ünïcode 12 wörds!"]
    best, where = T.Scorer(model).best(texts)
    for text, got, words in zip(texts, best, where):
        own = T.words_of(text)
        windows = [own[s:s + T.WINDOW] for s in T.window_starts(len(own))]
        logits = [plain_forward(model["p"], T.inputs(w, model["stats"])) for w in windows]
        assert got == pytest.approx(max(logits), abs=1e-4)
        assert words == windows[int(np.argmax(logits))]


def test_one_toxic_window_in_a_long_training_text(spark):
    """The executors find it among all windows of a 20,000-word text, and the polarities count the text once, whole."""
    rng = random.Random(8)
    long = prose(rng, 20_000).split()
    long[13_337:13_337] = ["vilest", "scumbag"]
    rows = spark.createDataFrame([(1, 1, " ".join(long)), (2, 0, prose(rng, 50)), (3, 1, "vilest scumbag " + prose(rng, 8)), (4, 0, prose(rng, 900)), (5, 0, None)], "id bigint, y int, text string")
    count = T.presence(rows)
    word, runs, real = T.hashed(["vilest"])
    assert count[0, 1, int(word[0] % T.STAT_ROWS)] == 2 and count[0, 0, int(word[0] % T.STAT_ROWS)] == 0
    brute = np.zeros_like(count)
    for r in rows.collect():
        w, rs, ok = T.hashed(sorted(set(T.words_of(r.text))) or [""])
        if r.text:
            brute[0, r.y, np.unique((w % T.STAT_ROWS).astype(int))] += 1
            brute[1, r.y, np.unique((rs[ok] % T.STAT_ROWS).astype(int))] += 1
    assert (count == brute).all()
    got = T.highest_windows(rows, {"p": None, "stats": [T.tables(T.without(count, y), 2, 3) for y in (0, 1)]})
    assert {"vilest", "scumbag"} & set(got[1]) and len(got[1]) == T.WINDOW and got[5] == []
    assert all(len(w) <= T.WINDOW for w in got.values())


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and columns whose names the stages use inside."""
    rng = random.Random(17)
    rows = [(i, prose(rng, rng.randint(20, 80)), rng.choice(["en", None]), rng.choice(["a", "b", None]), i, "x", 1.5) for i in range(40)]
    leak = "who built the old mill tower by the river bend. it was the miller of the upper town"
    rows += [(100, None, None, None, None, None, None), (101, "", "en", "a", 0, "y", 0.0), (None, prose(rng, 30), "en", "b", 1, "z", 2.0), rows[3], rows[3],
             (102, prose(rng, 9000), "en", "a", 2, "l", 1.0), (103, prose(rng, 30) + " " + leak, "en", "a", 3, "q", 1.0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, z double"
    for name, docs in (("odd", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(docs, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, leak), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 0, 1), (31, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        now, seen = spark.read.parquet(f"{d}/documents.parquet"), []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = corpus_pipeline.written(stage(spark, now, d), f"odd{k}")
            seen.append(now.collect())
            if k < 4:
                assert now.columns == [c.split()[0] for c in schema.split(", ")]
                assert {tuple(r) for r in seen[k]} <= set(docs)
        if not docs:
            assert not any(seen)
            continue
        assert len(seen[0]) == len(rows)                      # one class of labels only: nothing is rejected
        assert len(seen[1]) == len({(r.doc_id, r.text) for r in seen[1]}) and sum(r.doc_id == 3 for r in seen[1]) == 1
        assert 103 in {r.doc_id for r in seen[1]} - {r.doc_id for r in seen[2]} and len(seen[2]) == len(seen[1]) - 1
        assert len(seen[4]) == len(seen[3])
