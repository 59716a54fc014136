"""Benchmark decontamination: BM25 over test items with block-max pruning, then overlap checks.

The indexed side is the benchmark: question and answer of every test item (without an answer column its last sentence is the
answer) are cut into segments of their own (``segments_of``), and each is a document of an inverted index (term -> segments with BM25 impacts).  The query
side is every training passage: windows of ``2 * segment`` words, half overlapping, over each whole text, so every
stretch of ``segment`` words lies in one passage.  Scores are divided by the segment's score against
itself: 1 means that a passage holds all of its weighted terms.

Search is WAND with block maxima, for many passages at once.  A segment's commonest terms, as long as they
stay under the threshold together, are not essential: a passage without an essential term of any segment, or whose summed list maxima stay
under the threshold, is skipped; segments are stored in blocks of ``BLOCK`` and, for the passages left,
only blocks whose summed block maxima reach the threshold are opened and scored.  Both bounds
are upper bounds (stretches of ``GROUP`` passages are searched as one before their passages are), so all (passage, segment) pairs above the threshold are retrieved.  Runs of short parts, whose few terms weigh much and must all stand in a
passage, have lists and maxima of their own (a tier), so that they don't loosen the bounds of the long segments.

An item is retrieved if any of its segments is: the question at the top of a text and the answer at its end, or one of both in pieces, is
found by the other.  A retrieved item is verified on the words of the whole text: question and answer
are each compared as ``shingle``-word runs (a shorter part as one run) and a document leaks an item when
at least ``overlap`` of the question's and of the answer's runs stand in its text.

The index is built in shards: items are dealt into as many as keep each under ``shard_words`` words (their number is counted first), each
shard is built by one executor task from its items and their words' counts over all items, and is stored in the shared folder.  Tasks over documents
hold some batches of texts at a time and load the shards from there one after another, so nothing of the benchmark passes
through the driver, a task holds one shard, documents are read once, and every shard meets every passage (the stated query set against all rows, in blocks).

Nulls: null texts are empty, and an empty item can't leak; a null item_id or doc_id is kept as such.
Repeated rows are judged alike.  Very long texts are searched whole.  Empty tables give empty results.  Other columns are ignored, also clashing ones.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.common import scratch, table, written

K1, B = 1.2, 0.75
BLOCK = 16
GROUP = 4                # passages searched as one before they are searched each
LONG = 20                # words of a part that is indexed by its pieces, a shorter one by runs
CHUNK = 1 << 17          # bytes of texts searched together (or one longer text)
HELD = 32 << 20          # bytes of texts a task holds while it goes through the shards
TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def parts_of(question: str, answer: str | None) -> list[list[str]]:
    """Words of the question and of the answer; without an answer column the last sentence is the answer."""
    if answer is None:
        cut = [m.end() for m in re.finditer(r"[.!?]\s+", question.rstrip())]
        question, answer = (question[: cut[-1]], question[cut[-1]:]) if cut else (question, "")
    return [w for w in (tokens(question), tokens(answer)) if w]


def runs(words: list[str], shingle: int) -> set:
    k = min(shingle, len(words))
    return set(zip(*(words[i:] for i in range(k)))) if k else set()


class Tier:
    """Lists of some segments (term numbers, impacts) with list and block maxima."""

    def __init__(self, impacts: list[dict], owner: list[int], n_terms: int, threshold: float):
        self.essential = np.zeros(n_terms + 1, bool)         # a segment's terms without these stay under the threshold together
        for s in impacts:
            total = 0.0
            for t, v in sorted(s.items(), key=lambda x: x[1]):
                total += v
                if total >= threshold - 1e-9:
                    self.essential[t] = True
        self.owner, self.n_segments, self.threshold = owner, len(impacts), threshold
        rows = np.array([t for s in impacts for t in s], np.int64)
        cols = np.repeat(np.arange(len(impacts)), [len(s) for s in impacts])
        vals = np.array([v for s in impacts for v in s.values()], float)
        order = np.lexsort((cols, rows))
        self.post_seg, self.post_val, rows = cols[order], vals[order], rows[order]
        head = np.ones(len(rows), bool)                      # block maxima: postings of a term grouped by block
        block = self.post_seg // BLOCK
        head[1:] = (rows[1:] != rows[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(head)
        self.bm_block = block[first]
        self.bm_max = np.maximum.reduceat(self.post_val, first) if len(rows) else np.zeros(0)
        self.bm_at = np.searchsorted(rows[first], np.arange(n_terms + 1))
        self.bm_post = np.append(first, len(rows))           # where each block's postings begin
        self.list_max = np.zeros(n_terms + 1)                # the last, for words in no item, stays 0
        np.maximum.at(self.list_max, rows, self.post_val)

    def search(self, known: np.ndarray, starts: np.ndarray, stops: np.ndarray, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(passage, segment) numbers of all pairs that score ``threshold`` or more; passages are [start, stop) of term numbers (-1: no term)."""
        threshold = max(self.threshold, threshold or 0)
        hits = [np.zeros((2, 0), np.int64)]
        if not self.n_segments:
            return tuple(hits[0])
        bound = np.concatenate([[0.0], np.cumsum(self.list_max[known])])
        some = np.concatenate([[0], np.cumsum(self.essential[known])])
        live = np.flatnonzero((some[stops] > some[starts]) & (bound[stops] - bound[starts] >= threshold - 1e-9))     # essential terms, list maxima
        n_blocks = -(-self.n_segments // BLOCK)
        for at in range(0, len(live), 64):
            some = live[at:at + 64]
            inside = [known[starts[p]:stops[p]] for p in some]
            pairs = np.unique(np.concatenate([(i << 32) + w[self.list_max[w] > 0] for i, w in enumerate(inside)]))
            passage, term = pairs >> 32, pairs & 0xFFFFFFFF
            enough = np.bincount(passage, self.list_max[term], len(some)) >= threshold - 1e-9  # each term once
            passage, term = passage[enough[passage]], term[enough[passage]]
            if not len(term):
                continue
            n = self.bm_at[term + 1] - self.bm_at[term]                                       # block maxima
            cell = np.repeat(self.bm_at[term], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who = np.repeat(passage, n)
            top = np.bincount(who * n_blocks + self.bm_block[cell], self.bm_max[cell], len(some) * n_blocks) >= threshold - 1e-9
            opened = top[who * n_blocks + self.bm_block[cell]]
            cell, who = cell[opened], who[opened]
            if not len(cell):
                continue
            m = self.bm_post[cell + 1] - self.bm_post[cell]                                   # opened blocks only
            post = np.repeat(self.bm_post[cell], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            key, at_key = np.unique(np.repeat(who, m) * self.n_segments + self.post_seg[post], return_inverse=True)
            score = np.bincount(at_key, self.post_val[post])
            key = key[score >= threshold - 1e-9]
            hits.append(np.stack([live[at + key // self.n_segments], key % self.n_segments]))
        return tuple(np.concatenate(hits, axis=1))


class Index:
    """One shard.  ``items``: (item number, question, answer); ``df``: word -> segments
    holding it over all shards; ``n`` and ``mean``: number and mean length of all segments."""

    def __init__(self, items, df: dict, n: int, mean: float, segment: int, shingle: int, threshold: float = 0.6, overlap: float = 0.8):
        self.segment, self.shingle, self.threshold = segment, shingle, threshold
        self.parts, self.words, self.terms = {}, {}, {}
        tiers: list[tuple[list, list]] = [([], []), ([], [])]
        for number, question, answer in items:
            parts = parts_of(question or "", answer)
            self.words[number] = parts
            self.parts[number] = [runs(p, shingle) for p in parts]
            for exact, words in segments_of(parts, segment, shingle, overlap):
                count: dict[str, int] = {}
                for w in words:
                    count[w] = count.get(w, 0) + 1
                impact = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean)) for w, c in count.items()}
                own = sum(impact.values())
                impacts, owner = tiers[not exact]
                impacts.append({self.terms.setdefault(w, len(self.terms)): x / own for w, x in impact.items()})
                owner.append(number)
        self.tiers = [Tier(impacts, owner, len(self.terms), t) for (impacts, owner), t in zip(tiers, (1.0, threshold))]

    def known(self, words: list[str]) -> np.ndarray:
        """Term numbers of words, -1 for those in no item."""
        return np.fromiter(map(self.terms.get, words, [-1] * len(words)), np.int64, len(words))

    def search(self, texts: list[list[str]], threshold: float) -> list[set]:
        """For each text (words) the numbers of the items with a segment scoring at least ``threshold`` (not under the index's own) against some
        passage of it.  The passages of all texts are searched together."""
        if threshold < self.threshold:
            raise ValueError("the index was built for a higher threshold")
        step, found = self.segment, [set() for _ in texts]
        known = self.known([w for t in texts for w in t])
        size = np.array([len(t) for t in texts], np.int64)
        n = np.maximum(-(-(size - step) // step), 1)                     # passages of each text
        doc = np.repeat(np.arange(len(texts)), n)
        own = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        begin = np.cumsum(size) - size
        starts = begin[doc] + own * step
        stops = np.minimum(starts + 2 * step, (begin + size)[doc])
        runs, pieces = self.tiers

        def take(tier, passages, which, segs):
            for d, s in set(zip(doc[passages[which]].tolist(), segs.tolist())):
                found[d].add(tier.owner[s])

        every = np.arange(len(doc))
        take(runs, every, *runs.search(known, starts, stops))
        # stretches of GROUP passages first: a segment that no stretch holds, no passage of it does
        head = np.flatnonzero(own % GROUP == 0)
        tail = np.append(head[1:], len(doc)) - 1
        hit = np.zeros(len(head), bool)
        hit[pieces.search(known, starts[head], stops[tail], threshold)[0]] = True
        near = every[np.repeat(hit, tail - head + 1)]
        take(pieces, near, *pieces.search(known, starts[near], stops[near], threshold))
        return found

    def leaks(self, texts: list[str | None], threshold: float, overlap: float) -> list[list[tuple]]:
        """For each text (item number, question overlap, answer overlap) of the verified items."""
        words = [tokens(t) for t in texts]
        return [self.verified(w, c, overlap) if c else [] for w, c in zip(words, self.search(words, threshold))]

    def verified(self, words: list[str], candidates: set, overlap: float) -> list[tuple]:
        out, present = [], set(words)
        held: dict[int, set] = {}
        for number in sorted(candidates):
            # a run held begins with a word held: too few of them, and no runs need be looked at
            if any(sum(w in present for w in p) < overlap * len(r) - 1e-9 for p, r in zip(self.words[number], self.parts[number])):
                continue
            shares = []
            for part in self.parts[number]:
                k = len(next(iter(part)))
                if k not in held:
                    held[k] = set(zip(*(words[i:] for i in range(k))))
                shares.append(len(part & held[k]) / len(part))
            if min(shares) >= overlap:
                out.append((number, shares[0], shares[-1]))
        return out


def segments_of(parts: list[list[str]], segment: int, shingle: int, overlap: float) -> list[tuple[bool, list[str]]]:
    """The indexed segments of an item's parts, and whether a passage must hold all of their terms (else ``threshold`` of their weight).

    A part of ``LONG`` words or more is cut equally into pieces of at most ``segment`` words, two at least, so that a part that stands in pieces still
    has a whole one.  A shorter part, of whose m runs a leak holds all but overlap-many, is indexed by one run more than may be missing, evenly
    spaced: one of them stands whole in a text that holds the part.  Parts shorter than a run (a one-word answer stands everywhere) count only if
    no part is longer."""
    out = []
    for p in [p for p in parts if len(p) >= shingle] or parts:
        if len(p) >= LONG:
            k = max(-(-len(p) // segment), 2)
            edge = [len(p) * i // k for i in range(k + 1)]
            out += [(False, p[a:b]) for a, b in zip(edge, edge[1:])]
        else:
            each = list(dict.fromkeys(zip(*(p[i:] for i in range(min(shingle, len(p)))))))
            some = len(each) - int(np.ceil(overlap * len(each) - 1e-9)) + 1
            out += [(True, list(each[i * len(each) // some])) for i in range(some)]
    return out


def item_table(items: DataFrame, id_col: str, question: str, answer: str | None) -> DataFrame:
    """Distinct items (a repeated row is one item) with a number of their own."""
    a = F.col(f"`{answer}`") if answer else F.lit(None).cast("string")
    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), F.coalesce(F.col(f"`{question}`"), F.lit("")).alias("question"), a.alias("answer")).distinct()
    return rows.withColumn("number", F.xxhash64("item_id", "question", "answer"))


def build_shards(items: DataFrame, segment: int, shingle: int, shard_words: int, threshold: float, overlap: float) -> tuple[str, int]:
    """(path, number): the shards' indexes, each of about ``shard_words`` words at most, built and written by one executor task each."""
    def terms(batches):
        import pandas as pd

        for b in batches:
            got = []
            for shard, q, a in zip(b.shard, b.question, b.answer):
                for _, s in segments_of(parts_of(q, a), segment, shingle, overlap):
                    got.extend((shard, w, 1) for w in set(s))
                    got.append((shard, "", len(s)))          # the empty word counts segments and their words
            yield pd.DataFrame(got, columns=["shard", "word", "n"])

    def counted(rows):
        return rows.select("shard", "question", "answer").mapInPandas(terms, "shard int, word string, n bigint")

    total = counted(items.withColumn("shard", F.lit(0))).filter("word = ''").agg(F.count("*").alias("segments"), F.sum("n").alias("words")).first()
    if not total["segments"]:
        return "", 0
    n_shards = -(-total["words"] // shard_words)
    dealt = items.withColumn("shard", F.pmod("number", F.lit(n_shards)).cast("int"))
    words = written(counted(dealt).filter("word <> ''").groupBy("word", "shard").agg(F.count("*").alias("n")), "words")
    df = words.join(words.groupBy("word").agg(F.sum("n").alias("df")), "word").select("shard", "word", "df")
    n, mean = total["segments"], total["words"] / total["segments"]

    def build(key, rows, counts):
        import pandas as pd

        known = dict(zip(counts["word"], counts["df"]))
        index = Index(list(zip(rows["number"], rows["question"], rows["answer"])), known, n, mean, segment, shingle, threshold, overlap)
        return pd.DataFrame({"shard": [key[0]], "data": [pickle.dumps(index)]})

    path = scratch(items.sparkSession, "index")
    dealt.select("shard", "number", "question", "answer").groupBy("shard").cogroup(df.groupBy("shard")).applyInPandas(build, "shard int, data binary") \
         .write.parquet(path)
    return path, n_shards


def load_shard(path: str, shard: int) -> "Index | None":
    """A shard's index from the shared folder."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    got = ds.dataset(at, filesystem=store, format="parquet").to_table(filter=ds.field("shard") == shard).column("data").to_pylist()
    return pickle.loads(got[0]) if got else None


def leaks(docs: DataFrame, items: DataFrame, keys: list[str], text: str = "text", item_id: str = "item_id", question: str = "text",
          answer: str | None = None, threshold: float = 0.6, overlap: float = 0.8, shingle: int = 5, segment: int = 64,
          shard_words: int = 500_000) -> DataFrame:
    """(keys..., item_id, question_overlap, answer_overlap): every verified leak of every row of ``docs``."""
    known = written(item_table(items, item_id, question, answer), "benchmark")
    src = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("_text"))
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
    schema = ", ".join([*head, "number bigint", "question_overlap double", "answer_overlap double"])
    path, n_shards = build_shards(known, segment, shingle, shard_words, threshold, overlap)

    def run(batches):
        import pyarrow as pa

        loaded: dict[int, Index | None] = {}

        def shard(k):
            if k not in loaded:
                loaded.clear()                               # one at a time
                loaded[k] = load_shard(path, k)
            return loaded[k]

        def out(held):
            for k in range(n_shards):
                index = shard(k)
                if index is None:
                    continue
                for b in held:
                    texts, rows, hits = b.column(b.num_columns - 1), [], []
                    first, size = 0, 0
                    for i in range(len(texts) + 1):                 # texts of about CHUNK bytes are searched together
                        if i == len(texts) or size >= CHUNK:
                            for r, found in enumerate(index.leaks(texts[first:i].to_pylist(), threshold, overlap), first):
                                rows += [r] * len(found)
                                hits += found
                            first, size = i, 0
                        if i < len(texts) and texts[i].is_valid:
                            size += len(texts[i].as_buffer())
                    cols = [b.column(j).take(pa.array(rows, pa.int64())) for j in range(b.num_columns - 1)]
                    kinds = (pa.int64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([*cols, *(pa.array([h[j] for h in hits], kinds[j]) for j in range(3))],
                                                     [*keys, "number", "question_overlap", "answer_overlap"])

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= HELD or n_shards == 1:
                yield from out(held)
                held, size = [], 0
        yield from out(held)

    found = src.mapInArrow(run, schema)
    ids = known.select("number", "item_id")
    return found.join(ids, "number").select(*[F.col(f"`{k}`") for k in keys], F.col("item_id"), "question_overlap", "answer_overlap")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a verified leak, with their columns.  Leaking rows are matched back by the
    hash of their text, of which there is one row each."""
    whole = docs.select(F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("twin"), F.col(f"`{text}`").alias("text"),
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))      # a struct: no name can clash
    bad = written(leaks(whole.select("twin", "text"), items, ["twin"], "text", **options).select("twin").distinct(), "leaking")
    return whole.join(bad, "twin", "left_anti").select("row.*")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row per leak: doc_id, item_id and the shares of question and answer found."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
