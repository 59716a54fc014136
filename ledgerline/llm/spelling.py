"""Spelling variants: words one edit apart, found with blocked Gram matrices of letter counts.

Two words are near if they differ by exactly one inserted, deleted or replaced character.  Such words have lengths equal
or one apart, and their vectors of letter counts are at squared distance 2 at most (replaced) or 1 (inserted), so

1. Blocks.  One edit falls either into the first half of a word or behind it, so near words agree on the other half.  Each
   word goes to the blocks of its halves, as a word of a block's length s and as one of the adjacent length s + 1 (four rows a word).  Every
   near pair meets in a block; a pair that agrees on both halves is read from the first alone.
2. Gram matrices.  Rows of a block are letter counts; a NumPy product of two tiles gives all inner products and with the
   norms all squared distances.  Pairs at most two apart (lengths s with s, s with s + 1) are kept.
3. Edits.  Kept pairs are compared letter by letter.

Blocks above ``block_rows`` words are cut into chunks by hash and dealt out as pairs of chunks, so a hot block is compared whole by many
tasks; no task holds more than two chunks.  Words come as counted rows: a word that makes up a third of all
text is one row.  Texts are counted in Arrow batches, map side first; only words and counts are shuffled.

The form of a word is its near word of largest count (ties: smallest in code-point order) if that is at least ``ratio``
times its own.  Counts rise along forms, so they end; roots are found by pointer doubling over the words that have one.

Nulls: a null text has no words; a null doc_id counts as "".  Repeated rows count each time.  Very long texts are read whole.
Words of any characters are taken (letters outside the Latin ranges share columns, which only lowers distances).  Empty
tables give empty results.  Other columns are ignored, also clashing ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.common import table, written

TILE = 256
LETTERS = 26 + 64                       # a-z, and U+00C0 to U+00FF
HELD = 300_000                          # distinct words a task counts before it hands them on
CAPITALS = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


# ---------------------------------------------------------------- counting
def plain_word(doc_id, word: str, prefix: int) -> str:
    return word


def slipped_word(doc_id, word: str, prefix: int) -> str:
    """The word with one character lost if 199 divides the crc32 of "<doc_id>:<word>"; ``prefix``: crc32 of "<doc_id>:"."""
    h = zlib.crc32(word.encode(), prefix)
    if h % 199:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", pattern: str = "[A-Za-zÀ-ÿ]+", min_chars: int = 6,
                read=plain_word) -> DataFrame:
    """(word, n) of all texts: maximal runs of ``pattern``, A-Z in lower case, as ``read`` gives them, of ``min_chars`` or more."""
    src = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        import pyarrow as pa

        runs = re.compile(pattern)
        total: Counter = Counter()

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return got

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                prefix = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in Counter(runs.findall(t.as_py() or "")).items():
                    if len(word) >= min_chars:
                        word = read(i, word.lower() if word.isascii() else word.translate(CAPITALS), prefix)
                        if len(word) >= min_chars:
                            total[word] += n
                if len(total) >= HELD:
                    yield out()
        yield out()

    return src.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- near words
def letter_counts(words: list[str]) -> np.ndarray:
    """One row of letter counts a word (float32 holds them exactly)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    column = np.where((code >= 97) & (code < 123), code - 97, 26 + code % 64)
    return np.bincount(np.repeat(np.arange(len(words)), size) * LETTERS + column, minlength=len(words) * LETTERS).reshape(-1, LETTERS).astype(np.float32)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced character tells the words apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def near_pairs(words: list[str], group: np.ndarray, short: np.ndarray, side: np.ndarray, chunk: np.ndarray, across: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of near words of one group.  Rows come sorted by group and length; ``short``: s of the row's block, ``side``: the half
    it agrees on, ``chunk``/``across``: whether a group holds two chunks, which are then compared with each other only."""
    counts, size = letter_counts(words), np.fromiter(map(len, words), np.int64, len(words))
    norm = (counts * counts).sum(axis=1)
    out = []
    for i in range(0, len(words), TILE):
        a = slice(i, i + TILE)
        for j in range(i, len(words), TILE):
            b = slice(j, j + TILE)
            if group[j] > group[a][-1]:
                break                                                   # no group stands in both tiles
            if (size[a] > short[a]).all():
                continue                                                # two words of the longer length meet elsewhere
            near = norm[a, None] + norm[None, b] - 2 * (counts[a] @ counts[b].T) <= 2
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            # by group and length in order: the first is of the block's own length, whatever the second
            ok = (x < y) & (group[x] == group[y]) & (size[x] == short[x]) & (~across[x] | (chunk[x] != chunk[y]))
            for p, q in zip(x[ok].tolist(), y[ok].tolist()):
                if one_edit(words[p], words[q]):
                    half = int(short[p]) // 2
                    if not side[p] or words[p][:half] != words[q][:half]:
                        out.append((p, q))
    return out


def near_words(counted: DataFrame, block_rows: int = 4096) -> DataFrame:
    """(word, near, near_n): both directions of every pair of near words among the distinct words of ``counted`` (word, n).  ``block_rows`` sets
    how hot blocks are dealt; it does not change the pairs."""
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    less = F.floor((size - 1) / 2).cast("int")
    block = lambda s, side, piece: F.struct(s.cast("int").alias("s"), F.lit(side).alias("side"), piece.alias("piece"))
    blocks = F.array(block(size, 0, F.substr("word", F.lit(1), half)), block(size, 1, F.substr("word", half + 1)),
                     block(size - 1, 0, F.substr("word", F.lit(1), less)), block(size - 1, 1, F.substr("word", less + 2)))
    key = ["s", "side", "piece"]
    rows = counted.filter("word <> ''").select("word", "n", F.explode(blocks).alias("k")).select("k.*", "word", "n")
    hot = written(rows.groupBy(*key).count().filter(F.col("count") > block_rows)
                  .select(*key, F.ceil(F.col("count") / block_rows).cast("int").alias("chunks")), "hot")
    me = F.coalesce(F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"), F.lit(0))
    dealt = (rows.join(hot, key, "left").select(*key, "word", "n", me.alias("me"), F.coalesce("chunks", F.lit(1)).alias("chunks"))
             .select(*key, "word", "n", "me", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
             .select(*key, F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"), "me", size.alias("size"), "word", "n"))
    at = [*key, "i", "j"]

    def run(batches):
        import pyarrow as pa
        import pandas as pd

        def out(t):
            words, n = t.word.tolist(), t.n.to_numpy()
            pairs = near_pairs(words, t.ngroup.to_numpy(), t.s.to_numpy(), t.side.to_numpy(), t.me.to_numpy(), (t.i != t.j).to_numpy())
            both = pairs + [(q, p) for p, q in pairs]
            return pa.RecordBatch.from_arrays([pa.array([words[p] for p, _ in both], pa.string()), pa.array([words[q] for _, q in both], pa.string()),
                                               pa.array([int(n[q]) for _, q in both], pa.int64())], ["word", "near", "near_n"])

        held, rows = [], 0

        def whole(last: bool):
            """The rows held up to the last group change (all at the end)."""
            t = pd.concat(held, ignore_index=True)
            change = (t[at] != t[at].shift()).any(axis=1)
            t["ngroup"] = change.cumsum()
            cut = len(t) if last else int(np.flatnonzero(change)[-1])
            return t[:cut], t[cut:].drop(columns="ngroup")

        for b in batches:
            held.append(b.to_pandas())
            rows += b.num_rows
            if rows >= 8 * TILE:
                done, rest = whole(False)
                held, rows = [rest], 0                         # a long group waits for its end, looked for once in 8 tiles
                if len(done):
                    yield out(done)
        if held:
            done, _ = whole(True)
            if len(done):
                yield out(done)

    return dealt.repartition(*at).sortWithinPartitions(*at, "size", "word").mapInArrow(run, "word string, near string, near_n bigint")


# ---------------------------------------------------------------- forms and roots
def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, for the words of ``forms`` (word, form).  Each round doubles what a word has followed."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("w"), F.col("root").alias("ahead"))
        step = written(now.join(ahead, F.col("root") == F.col("w"), "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def spelling_variants(counted: DataFrame, ratio: int = 5, block_rows: int = 4096) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``counted`` (word, n; words distinct)."""
    known = written(counted.select("word", "n"), "words")
    near = (near_words(known, block_rows).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")))
    best = written(known.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                           F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"))
                   .select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), "forms")
    ends = roots(best.filter("form IS NOT NULL").select("word", "form"))
    return best.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """Per frequent word: its form, root and counts."""
    counted = word_counts(table(spark, sf_dir, "documents"), read=slipped_word)
    return spelling_variants(counted.filter("n >= 5"))
