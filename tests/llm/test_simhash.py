import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash as S


def brute_fp(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def brute_groups(fps, radius):
    n = len(fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint():
    texts = ["A b C d e", "one two", "", None, "É à É à x\x1cy", "w " * 500, " ".join(map(str, range(3000)))]
    got = S.fingerprint_texts([t.encode() if t is not None else None for t in texts])
    assert [int(g) for g in got] == [brute_fp(t) for t in texts]


def test_flush_boundaries(monkeypatch):
    text = " ".join(map(str, range(200))).encode()
    want = S.fingerprint_texts([text, b"a b c d", text])
    monkeypatch.setattr(S, "FLUSH", 17)
    assert (S.fingerprint_texts([text, b"a b c d", text]) == want).all()


def near(rng, n, flips):
    base = rng.integers(0, 1 << 63, 1 + n // 8, dtype=np.uint64)
    out = []
    for i in range(n):
        x = int(base[i % len(base)])
        for j in rng.integers(0, 64, rng.integers(0, flips + 1)):
            x ^= 1 << int(j)
        out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("blocks,bucket_rows", [(4, 4096), (5, 4096), (5, 8), (6, 3)])
def test_groups_equal_brute_force(spark, blocks, bucket_rows, monkeypatch):
    rng = np.random.default_rng(blocks)
    fps = near(rng, 500, 4)
    df = spark.createDataFrame([(S.signed(f),) for f in fps], "fp bigint")
    comp = {r.node: r.root for r in S.components(S.links(df, 3, blocks, bucket_rows)).collect()}
    mine = [comp.get(S.signed(f), S.signed(f)) for f in fps]
    want = brute_groups(fps, 3)
    groups = {}
    for a, b in zip(mine, want):
        assert groups.setdefault(b, a) == a
    assert len(set(groups.values())) == len(groups)


def test_dense_bucket():
    rng = np.random.default_rng(1)
    fps = np.array(near(rng, 700, 3)[:600] + [int(x) for x in rng.integers(0, 1 << 63, 100)], np.uint64)
    end = np.full(len(fps), len(fps))
    label = S.local_groups(fps, end, 3)
    assert label.tolist() == brute_groups([int(x) for x in fps], 3)


def test_rows_and_odd_cases(spark):
    rows = [(3, "a b c d", 1), (1, "A B C D", 2), (1, "A B C D", 2), (7, "", 3), (8, None, 4), (None, "q r s t u", 5), (9, "q r s t u", 6), (4, "x y", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = sorted((r[0] is None, r[0] or 0, r[3]) for r in S.simhash_groups(docs, ["doc_id"]).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 3, 1), (False, 4, 4), (False, 7, 7), (False, 8, 7), (False, 9, 9), (True, 0, 9)]
    kept = sorted((r.doc_id, r.text) for r in S.keep_one(docs).collect())
    assert kept == [(1, "A B C D"), (4, "x y"), (7, ""), (9, "q r s t u")]
    empty = spark.createDataFrame([], docs.schema)
    assert S.keep_one(empty).columns == docs.columns
    assert S.simhash_groups(empty, ["doc_id"]).count() == 0


def test_chain_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.root for r in S.components(e).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


def test_keep_one_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", 4, 5, "r", 6, 7), (2, "a b c d", 8, 9, None, 1, 2)],
                                 "doc_id bigint, text string, _twin int, id int, row string, kept_id int, _t int")
    got = S.keep_one(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "a b c d", 4, 5, "r", 6, 7)]
