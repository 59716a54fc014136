import zlib
from array import array

import numpy as np
import pytest

from ledgerline.llm import token_output as T
from ledgerline.llm.common import scratch


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for bits in (1, 5, 13, 16, 17, 31):
        ids = rng.integers(0, 1 << bits, 1001, dtype=np.uint32)
        raw = T.pack(ids, bits)
        assert len(raw) == -(-1001 * bits // 8)
        assert (T.unpack(raw, bits, 0, 1001) == ids).all()
        assert (T.unpack(raw, bits, 37, 200) == ids[37:237]).all()


def test_bits():
    assert [T.id_bits(v) for v in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_crc_combination():
    data = bytes(range(256)) * 9
    cut = [data[:100], data[100:101], b"", data[101:]]
    assert T.combined_crc([(i, len(p), zlib.crc32(p)) for i, p in enumerate(cut)]) == zlib.crc32(data)


ODD = ["", None, "  ", "Hello, World. it's DON'T 1234 a1b2", "é́ ́a ﬁ İ Σας", "x\x1cy\x85z\u2028q\xa0w", "<|endoftext|>a <|startoftext|>",
       "a<|endoftext|>b", "::: !!, -- ... 'll'll 's", "Éa É.a ÉCOLE. été, ñ! ß? ẞ. İ. ª. ×÷ aª µ. Ÿ, A.B,C a.", "日本語 テキスト\tA.\nB", "\u0345 \u0301b", "Tab\x0bvt\x0cff\rcr"]


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 5)
    words = T.WordIds(T.default_tokenizer())
    for text in ("a b c d e f. g! h i j k l a b c", "Été, x. été y. z w. a b"):
        assert np.frombuffer(T.encode_text(text.encode(), words), "<u4").tolist() == words.tok.encode(text, add_special_tokens=False).ids


def test_words_equal_whole_text():
    words = T.word_ids(T.default_tokenizer())
    for t in ODD:
        want = words.tok.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(T.encode_text((t or "").encode(), words), "<u4").tolist() == want, t


def test_plain_words_are_cut_into_known_pieces():
    """Visible ASCII, Latin-1 and punctuation words give the tokenizer's ids from their pieces, without a full encoding."""
    import random
    rng = random.Random(7)
    signs = [chr(c) for c in [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]]
    texts = signs + ["aux&&&", "Anoi***", "ÉCOLE%%%", "it's'll", "x'Sy're12", "don’t", "“Été”—ß!", "a1²b½", "'", "''s", "ªº.µ", "<<|>", "1,5.", "<|x|>", "<|endoftext|>s"]
    texts += ["".join(rng.choice(signs + list("aeiouABC'stl.,19éÈ") * 12) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    words = T.WordIds(T.default_tokenizer())
    whole = [array("I", e.ids).tobytes() for e in words.tok.encode_batch(texts, add_special_tokens=False)]

    class Full:
        model, calls = words.tok.model, 0

        def encode(self, *a, **k):
            Full.calls += 1
            return real.encode(*a, **k)

    real, words.tok = words.tok, Full()
    for t, ids in zip(texts, whole):
        assert T.encode_text(t.encode(), words) == ids, t
    assert Full.calls == len({t for t in texts if "<|" in t})


@pytest.mark.parametrize("block_ids", [7, 1 << 16])
def test_files(spark, block_ids):
    tok = T.default_tokenizer()
    rows = [(i * 3 % 11, ODD[i % len(ODD)], "x") for i in range(24)] + [(5, "long " * 300, "y"), (None, "null id", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    path = scratch(spark, "t")
    T.write_tokens(docs, path, tok, T.vocabulary_size(tok), block_ids=block_ids)
    got = sorted(map(tuple, T.read_checksums(spark, path, block_ids).collect()), key=lambda r: r[1])
    words = T.word_ids(tok)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [g[0] for g in got] == [r[0] for r in sorted(rows, key=key)]
    want = {}
    for d, t, _ in rows:
        ids = words.tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for d, start, n, crc in got:
        assert start == at
        at += n
        want[d].remove((n, crc))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert T.token_table(docs).count() == 0
