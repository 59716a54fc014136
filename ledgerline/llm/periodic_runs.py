"""Periodic runs of words: recursive frequency splitting, then a lag scan.

A run is a stretch of consecutive words with smallest period q, at least ``min_length`` words and ``min_copies``
periods long, that no neighbouring word extends with period q.

1. Splitting.  A run of period q and length n >= min_copies * q holds each of its words at least ``min_copies`` times, so a
   word that stands less often in a segment joins no run there and cuts it.  The pieces have counts of
   their own; they are cut again until no word is too rare.  All texts of a chunk are cut together, round after
   round; if a round leaves more than half of its words to the next, the rest is settled piece by piece: the smaller
   pieces are counted anew and taken off the counts of the largest, so even odd texts cost n log n.
2. Lag scan.  For each lag q up to a third of a surviving segment the stretches of words equal to those q
   later are found.  Such a stretch of a run is 2q long at least and so holds one whole block [kq, kq + q): only blocks are compared
   (by sums of a rolling hash, n / q of them), matches are extended word by word and compared as words.  Blocks inside a
   run already found whose period divides q are left out, as the stretch there is that run again.

A word is dropped if some run contains it after that run's first q words.

Texts are read in Arrow batches and nothing is shuffled: a text's work depends on that text alone, and a lost task
repeats its own rows.  Chunks hold about ``CHUNK`` bytes of text, or one longer text.

Nulls: a null or empty text has no words, no runs and the empty text left; a null doc_id stays null (and counts as "" where
the query hashes it).  Repeated rows give repeated rows.  Texts are read whole, however long.  Ties (runs of one start) are ordered by period.
Empty tables give empty results.  Other columns are ignored, also clashing ones.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import chain, count

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.common import let, split_words, table

CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


# ---------------------------------------------------------------- splitting
def cut(ids: np.ndarray, start: np.ndarray, end: np.ndarray, copies: int):
    """One round over the segments [start, end): those without a rare word, and the pieces of the others."""
    size = end - start
    own = np.repeat(np.arange(len(start)), size)
    at = np.arange(len(own)) + np.repeat(start - np.cumsum(size) + size, size)
    _, inverse, counts = np.unique(own * (int(ids.max(initial=0)) + 1) + ids[at], return_inverse=True, return_counts=True)
    common = counts[inverse] >= copies
    whole = np.ones(len(start), bool)
    whole[own[~common]] = False
    stays = common & ~whole[own]
    edge = np.ones(len(own) + 1, bool)                  # where the segment or the kind of word changes
    edge[1:-1] = (own[1:] != own[:-1]) | (stays[1:] != stays[:-1])
    first = np.flatnonzero(edge[:-1] & stays)
    last = np.flatnonzero(edge[1:] & stays)
    return whole, at[first], at[last] + 1


def settled(ids: np.ndarray, lo: int, hi: int, least: int, copies: int) -> list[tuple[int, int]]:
    """The surviving pieces of one segment, whatever the number of rounds."""
    places = defaultdict(list)
    for i, w in enumerate(ids[lo:hi].tolist(), lo):
        places[w].append(i)
    total = {w: len(p) for w, p in places.items()}
    out, work = [], [(lo, hi, total, [w for w, n in total.items() if n < copies])]
    while work:
        lo, hi, have, rare = work.pop()
        if hi - lo < least:
            continue
        if not rare:
            out.append((lo, hi))
            continue
        cuts = sorted(i for w in rare for i in places[w][bisect_left(places[w], lo):bisect_left(places[w], hi)])
        for w in rare:
            del have[w]
        pieces = [(a + 1, b) for a, b in zip([lo - 1, *cuts], [*cuts, hi])]
        largest = max(pieces, key=lambda p: p[1] - p[0])
        fewer = set()
        for a, b in pieces:
            if (a, b) != largest and a < b:
                small = dict(Counter(ids[a:b].tolist()))
                for w, n in small.items():
                    have[w] -= n
                    fewer.add(w)
                work.append((a, b, small, [w for w, n in small.items() if n < copies]))
        for w in [w for w in fewer if not have[w]]:
            del have[w]
        work.append((*largest, have, [w for w in fewer if w in have and have[w] < copies]))
    return out


def segments(ids: np.ndarray, start: np.ndarray, end: np.ndarray, least: int, copies: int) -> list[tuple[int, int]]:
    """Segments in which every word stands ``copies`` times or more, ``least`` words or longer, in order."""
    out: list[tuple[int, int]] = []
    before = None
    while True:
        long = end - start >= least
        start, end = start[long], end[long]
        left = int((end - start).sum())
        if not left:
            break
        if before is not None and 2 * left > before:
            out += chain.from_iterable(settled(ids, a, b, least, copies) for a, b in zip(start.tolist(), end.tolist()))
            break
        before = left
        whole, a, b = cut(ids, start, end, copies)
        out += zip(start[whole].tolist(), end[whole].tolist())
        start, end = a, b
    return sorted(out)


# ---------------------------------------------------------------- lag scan
def equal_stretch(x: np.ndarray, q: int, lo: int, hi: int) -> tuple[int, int]:
    """The stretch around [lo, hi) of positions equal to those q later; the blocks beside it differ somewhere."""
    a = max(lo - q, 0)
    differ = np.flatnonzero(x[a:lo] != x[a + q:lo + q])
    first = a + int(differ[-1]) + 1 if len(differ) else a
    b = min(hi + q, len(x) - q)
    differ = np.flatnonzero(x[hi:b] != x[hi + q:b + q])
    return first, hi + int(differ[0]) if len(differ) else b


def runs_in(x: np.ndarray, min_length: int = 24, min_copies: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array of word numbers."""
    n, out = len(x), []
    v = x.astype(np.uint64) + np.uint64(1)
    v = (v ^ (v >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    v ^= v >> np.uint64(29)
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE, np.uint64))])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(v * power[:n])])
    again = defaultdict(list)                           # lag -> known runs whose period divides it
    for q in range(1, n // min_copies + 1):
        least = max(min_length, min_copies * q)
        if least > n:
            break
        edge = sums[:n + 1:q]                           # blocks [kq, kq + q)
        block = edge[1:] - edge[:-1]
        same = block[:-1] * power[q] == block[1:]
        for s, length, p in again.pop(q, ()):
            same[-(-s // q):(s + length - 2 * q) // q + 1] = False
            if min_copies * (q + p) <= length:
                again[q + p].append((s, length, p))
        hit = np.flatnonzero(same)
        if not len(hit):
            continue
        breaks = np.flatnonzero(np.diff(hit) > 1)
        for i, j in zip(hit[np.r_[0, breaks + 1]].tolist(), hit[np.r_[breaks, len(hit) - 1]].tolist()):
            lo, hi = i * q, (j + 1) * q
            if np.array_equal(x[lo:hi], x[lo + q:hi + q]):
                stretches = [equal_stretch(x, q, lo, hi)]
            else:                                       # a clash of hashes: the lag is compared word by word there
                differ = lo + np.flatnonzero(x[lo:hi] != x[lo + q:hi + q])
                inner = [equal_stretch(x, q, a, b) for a, b in zip([lo, *differ + 1], [*differ, hi]) if a < b]
                stretches = sorted(set(inner))
            for s, e in stretches:
                length = e + q - s
                if length >= least:
                    out.append((s, length, q))
                    if min_copies * 2 * q <= length:
                        again[2 * q].append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of_words(texts: list[list], min_length: int = 24, min_copies: int = 3) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several lists of words."""
    number = defaultdict(count().__next__)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(ends[-1]) if len(ends) else 0)
    out: list[list] = [[] for _ in texts]
    starts = ends - [len(t) for t in texts]
    for a, b in segments(ids, starts, ends, min_length, min_copies):
        d = int(np.searchsorted(ends, a, "right"))
        at = a - int(starts[d])
        out[d] += [(at + s, n, q) for s, n, q in runs_in(ids[a:b], min_length, min_copies)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words left, joined by single spaces."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            gone[s + q] += 1
            gone[s + n] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, keys: list[str], text: str = "text", min_length: int = 24, min_copies: int = 3) -> DataFrame:
    """(keys..., n_words, runs, collapsed): per row its runs (by start, then period) and the text without their repeats.
    ``min_copies`` is 3 at least: a stretch of two periods need not hold a whole block."""
    if min_copies < 3:
        raise ValueError("min_copies must be 3 or more")
    src = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("binary").alias("_text"))
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
    schema = ", ".join([*head, "n_words bigint", f"runs {RUNS}", "collapsed string"])

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def result(part):
            texts = [(t or b"").split() for t in part.column(part.num_columns - 1).to_pylist()]     # bytes: ASCII white space only
            found = runs_of_words(texts, min_length, min_copies)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
            left = pa.array([collapsed(w, r) for w, r in zip(texts, found)], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(list(map(len, texts)), pa.int64()),
                                               pa.array(rows, kind), left], [*keys, "n_words", "runs", "collapsed"])

        for b in batches:
            first, held = 0, 0
            for i, size in enumerate(b.column(b.num_columns - 1)):
                held += len(size.as_buffer()) if size.is_valid else 0
                if held >= CHUNK:
                    yield result(b.slice(first, i + 1 - first))
                    first, held = i + 1, 0
            if first < b.num_rows:
                yield result(b.slice(first))

    return src.mapInArrow(run, schema)


# ---------------------------------------------------------------- registered query
def stretched(doc_id: Column, text: Column) -> Column:
    """The text that the query reads: in one of ten documents, by its crc32, the words from one on repeat with a period of their own."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))

    def repeated(w):
        n, g = F.size(w), F.floor(h / 10)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + F.pmod(i - a, p)).cast("int"))).otherwise(x)), " ")

    return F.when(F.pmod(h, F.lit(10)) == 0, let(split_words(text), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Per document: the number of runs, the run of greatest exponent, and digests of all runs and of the text left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", stretched(F.col("doc_id"), F.col("text")).alias("text"))
    rows = periodic_runs(docs, ["doc_id"])
    # exponents are compared exactly, as cross products; runs come by start and period, so the first of equals stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return (rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"),
                    F.expr("(1000 * b.length) div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"))
