import hashlib
import random

import numpy as np
import pytest

from ledgerline.llm import fingerprints as M


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def similarity(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    m = M.MinHash()
    base = [prose(rng, rng.randint(3, 400)) for _ in range(40)]
    texts = base + [t[:len(t) * rng.randint(2, 9) // 10] + " " + prose(rng, 30) for t in base] + ["", None, "one", "One", "one two", "a b c d e"]
    data = [None if t is None else t.encode() for t in texts]
    sig = m.signatures(data)
    assert sig.shape == (len(texts), 128) and sig.dtype == np.uint32
    errors = [(sig[i] == sig[j]).mean() - similarity(texts[i], texts[j]) for i in range(len(texts)) for j in range(i)]
    assert abs(np.mean(errors)) < 0.002 and np.max(np.abs(errors)) < 0.2
    alone = np.concatenate([m.signatures([t]) for t in data])           # what stands beside a text does not matter
    assert (alone == sig).all()
    assert (sig[texts.index("one")] == sig[texts.index("One")]).all() and (sig[texts.index("")] == M.NONE).all()


def test_functions_are_universal():
    """Two different keys meet under a drawn function with probability about 2^-32; least values are spread evenly."""
    m = M.MinHash(permutations=512)
    x = np.random.default_rng(0).integers(0, 1 << 32, 1000, np.uint64)
    values = (x[None] * m.a[:, None] + m.b[:, None]) >> np.uint64(32)
    assert np.bincount(values.argmin(axis=1), minlength=1000).max() <= 6
    assert len(np.unique(values)) > 0.999 * values.size * (1 - values.size / 2 ** 33)


def test_shingles_equal_plain():
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (0, 1, 4, 5, 6, 50)] + ["", "a b a b a b a b", "A B a b a b a b"]
    hashes, n = M.MinHash().shingles([t.encode() for t in texts])
    seen = {}
    for t, part in zip(texts, np.split(hashes, np.cumsum(n)[:-1])):
        words = t.encode().lower().split()
        plain = [tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))] if words else []
        assert len(plain) == len(part)
        for p, h in zip(plain, part.tolist()):
            assert seen.setdefault(h, p) == p
    assert len(set(seen.values())) == len(seen)


def edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (i, t, *_), (_, f, *_) in zip(rows, rows[1:] + rows[:1]):
        t, f = t or "", f or ""
        k = len(t) // 2
        yield i, t, t[:len(t) - k] + f[:k], f


@pytest.mark.parametrize("partitions, chunk", [(8, 1 << 19), (3, 60)])
def test_with_next(spark, tmp_path, monkeypatch, partitions, chunk):
    monkeypatch.setattr(M, "CHUNK", chunk)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = random.Random(3)
        ids = rng.sample(range(-500, 10 ** 12), 150) + [10 ** 13]
        rows = [(i, prose(rng, rng.randint(0, 60)) + rng.choice(["", " é日本𝄞" * 5]), 0) for i in ids]
        rows += [(7, None, 1), (8, "", 2), (None, "no id here", 3), (9, "x " * 9000, 4), (ids[4], rows[4][1], 5), (ids[4], "same id", 6), (None, None, 7)]
        spark.createDataFrame(rows, "doc_id bigint, text string, near_next int").write.parquet(str(tmp_path / "documents.parquet"))
        got = M.op12_fingerprints(spark, str(tmp_path))
        assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        m = M.MinHash()
        want = []
        for i, t, e, f in edited(rows):
            a, b, c = (m.signatures([x.encode()])[0] for x in (t, e, f))
            want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a.astype(">u4").tobytes().hex(), b.astype(">u4").tobytes().hex(), (a == b).mean(), (a == c).mean()))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(float(x) if isinstance(x, np.floating) else x for x in w)) for w in want)
        for name, some in (("one", rows[:1]), ("none", [])):
            spark.createDataFrame(some, "doc_id bigint, text string, near_next int").write.parquet(str(tmp_path / name / "documents.parquet"))
            got = M.op12_fingerprints(spark, str(tmp_path / name)).collect()
            assert len(got) == len(some) and all(r.near_next == 1 for r in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


@pytest.mark.parametrize("cluster_rows", [2000, 5])
def test_classes_equal_brute_force(spark, cluster_rows):
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.randint(20, 120)).split()
        for _ in range(rng.choice([1, 2, 12])):
            some = list(base)
            for _ in range(rng.randint(0, 3)):
                some[rng.randrange(len(some))] = f"e{rng.randrange(100)}"
            texts.append(" ".join(some))
    texts += [texts[0], texts[0].upper(), "", None, "one two", "one  two", "\n"]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, texts[1], 0), (None, "null id " + prose(rng, 20), 0)]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, r in enumerate(rows):
        for j, s in enumerate(rows[:i]):
            if similarity(r[1], s[1]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted(str((r[0], least.get(find(i)))) for i, r in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node int")
    assert sorted(str(tuple(r)) for r in M.near_classes(df, ["doc_id"], cluster_rows=cluster_rows).collect()) == want
    assert M.near_classes(df.limit(0), ["doc_id"]).count() == 0
    assert M.fingerprints(df, ["doc_id"]).count() == len(rows)
