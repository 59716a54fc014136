import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ledgerline.llm import periodic_runs as P


def plain_runs(words, min_length=24, copies=3):
    """Every lag compared word by word; the smallest period of each stretch by trial."""
    n, out = len(words), {}
    for q in range(1, n // copies + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, copies * q):
                out.setdefault((i, j + q - i), q)          # lags come in order: the first is the smallest period
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def periodic_text(rng):
    parts = []
    for _ in range(rng.randint(1, 5)):
        vocabulary = rng.choice([1, 2, 3, 30, 400])
        if rng.random() < 0.5:
            parts += [f"v{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 60))]
        else:
            unit = [f"v{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, 25))]
            length = rng.randint(1, 150)
            parts += (unit * length)[:length]
    return parts


def test_equals_plain_scan():
    rng = random.Random(1)
    texts = [periodic_text(rng) for _ in range(250)]
    want = [plain_runs(t) for t in texts]
    assert P.runs_of_words(texts) == want
    assert sum(map(len, want)) > 100
    for length, copies in ((9, 3), (6, 4)):
        assert P.runs_of_words(texts[:60], length, copies) == [plain_runs(t, length, copies) for t in texts[:60]]


def test_binary_texts_with_many_runs():
    rng = random.Random(2)
    texts = [[rng.choice("ab") for _ in range(n)] for n in (50, 120, 300)] + [list("ab" * 12), list("ab" * 11 + "a"), list("a" * 24), list("a" * 23)]
    assert P.runs_of_words(texts, 4, 3) == [plain_runs(t, 4, 3) for t in texts]
    assert P.runs_of_words(texts[3:]) == [[(0, 24, 2)], [], [(0, 24, 1)], []]


def test_settling_equals_rounds():
    rng = random.Random(3)
    for _ in range(40):
        ids = np.array([int(rng.paretovariate(0.8)) % 60 for _ in range(400)])
        start, end, want = np.array([0]), np.array([400]), []
        while len(start):                                   # rounds only
            whole, a, b = P.cut(ids, start, end, 3)
            want += zip(start[whole].tolist(), end[whole].tolist())
            start, end = a, b
        want = sorted((a, b) for a, b in want if b - a >= 5)
        assert sorted(P.settled(ids, 0, 400, 5, 3)) == want
        assert P.segments(ids, np.array([0]), np.array([400]), 5, 3) == want


def test_many_rounds_stay_cheap():
    """Each cut makes one more word rare: as many rounds as a third of the words."""
    n = 30_000
    ids = np.array([w for i in range(n) for w in (i + 1, i, i)])
    import time
    t = time.time()
    assert P.segments(ids, np.array([0]), np.array([len(ids)]), 24, 3) == []
    assert time.time() - t < 20


def test_clash_of_hashes(monkeypatch):
    rng = random.Random(4)
    texts = [periodic_text(rng) for _ in range(60)]
    want = [plain_runs(t) for t in texts]
    monkeypatch.setattr(P, "BASE", np.uint64(0))            # every block after the first word hashes alike
    assert P.runs_of_words(texts) == want


def test_long_periodic_text():
    assert P.runs_of_words([["a", "b"] * 150_000 + ["c"]]) == [[(0, 300_000, 2)]]


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["\n", " ", "\t\x0b "]).join(periodic_text(rng)), i) for i in range(150)]
    rows += [(900, None, 0), (901, "", 0), (None, "a b " * 40, 0), (902, " \n ", 1), (3, rows[3][1], 3), (903, "  x y " * 30, 1), (904, "un deux " * 9000, 1)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string, start int").write.parquet(path)
    got = P.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: str(r)
    want = []
    for i, t, _ in rows:
        if i == 904:
            words = (t or "").split()
            assert len(words) == 18_000
            want.append((904, 1, 0, 18_000, 2, 9_000_000, hashlib.sha256(b"0,18000,2\n").hexdigest(), hashlib.sha256(b"un deux").hexdigest()))
        else:
            want.append(plain_row(i, t))
    assert zlib.crc32(b"904") % 10 != 0
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert P.op11_periodic_runs(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("size", [50])
def test_chunks_do_not_matter(spark, monkeypatch, size):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, " ".join(periodic_text(rng))) for i in range(80)], "doc_id bigint, body string")
    whole = sorted(map(str, P.periodic_runs(df, ["doc_id"], "body").collect()))
    monkeypatch.setattr(P, "CHUNK", size)
    assert sorted(map(str, P.periodic_runs(df, ["doc_id"], "body").collect())) == whole
