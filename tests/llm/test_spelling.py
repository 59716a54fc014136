import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import spelling as S


def plain_near(a, b):
    if a == b:
        return False
    letters = set(a + b)
    edits = {a[:i] + a[i + 1:] for i in range(len(a))} | {a[:i] + c + a[i + 1:] for i in range(len(a)) for c in letters}
    return b in edits | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters}


def plain_table(counts):
    near = {w: sorted(v for v in counts if abs(len(v) - len(w)) < 2 and plain_near(w, v)) for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        end = w
        while form[end] is not None:
            end = form[end]
        out.append((w, form[w], end, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def vocabulary(rng, n):
    out = set()
    while len(out) < n:
        w = "".join(rng.choice("aabcéñ") for _ in range(rng.randint(1, 9)))
        out.add(w)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w))
            out.add(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcßz") + w[i:], w[:i] + rng.choice("xyz") + w[i + 1:]]) or "a")
    return sorted(out)


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_variants_equal_brute_force(spark, block_rows):
    rng = random.Random(1)
    counts = {w: int(5 ** rng.uniform(0, 5)) for w in vocabulary(rng, 500)}
    counts |= {"日本語学習者": 60, "日本語学習": 5, "Ελληνικά": 9, "Ελληνικα": 90}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    want = plain_table(counts)
    assert sum(r[1] is not None for r in want) > 50 and any(r[2] != r[1] for r in want if r[1])
    assert sorted(map(tuple, S.spelling_variants(df, block_rows=block_rows).collect())) == want


def test_pairs_over_many_tiles(spark, monkeypatch):
    """All words share a half, so one block spans many tiles and batches."""
    rng = random.Random(2)
    words = sorted({"abc" + "".join(rng.choice("abcd") for _ in range(rng.choice([3, 4]))) for _ in range(260)})
    monkeypatch.setattr(S, "TILE", 16)
    got = Counter((r.word, r.near) for r in S.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")).collect())
    assert got == Counter((a, b) for a in words for b in words if plain_near(a, b))


def test_distances_and_edits():
    words = ["letter", "lettre", "leter", "latter", "éclair", "eclair", "zzzzzz"]
    c = S.letter_counts(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert ((c[i] - c[j]) ** 2).sum() == sum((Counter(a)[x] - Counter(b)[x]) ** 2 for x in set(a + b))
            assert S.one_edit(a, b) == plain_near(a, b)
    assert not np.any(c < 0)


def plain_counts(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "HELD", 50)
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéÀ×") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice([str.upper, str, str.title])(stems[int(rng.paretovariate(0.6)) % 60]) for _ in range(rng.randint(0, 250))) + rng.choice(["", " a1b2_letters-12"]), i) for i in range(300)]
    rows += [(900, None, 0), (901, "", 0), (None, "Wörter " * 40 + "ÀÉÎÕÜß" * 3, 0), (5, rows[5][1], 5), (902, "letters " * 9000 + "leters " * 7, 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, word int").write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op13_spelling(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_table(plain_counts([r[:2] for r in rows]))
    assert any(r[1] for r in want) and len(want) > 60
    assert sorted(map(tuple, got.collect())) == want
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert S.op13_spelling(spark, str(tmp_path / "none")).count() == 0
