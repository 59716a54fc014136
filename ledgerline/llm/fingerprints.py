"""Document fingerprints by MinHash, and near duplicates by their bands.

A text's shingles are its runs of ``shingle`` words (ASCII lower case; fewer words: the whole sequence), hashed to 32 bits.
Each of ``permutations`` universal hash functions (multiply-add-shift, 64-bit odd multipliers, seeded) maps all shingles in one
numpy pass over many texts, and the least value of each text is one number of its signature.  The share of equal numbers of two
signatures estimates the Jaccard similarity of their shingle sets (standard error at most 0.045 with 128).

``near_classes`` finds near duplicates: texts with equal shingle sets collapse to one node by a digest; signatures are cut into bands
and nodes that share a band are joined in Spark to candidate clusters (a star from each band value's least node, then connected
components), so that a node's text is read in one cluster only.  Inside a cluster every pair that shares a band is verified by the
exact Jaccard similarity of the shingle sets, unless links found already connect it; the links' components are the classes.  Clusters above ``cluster_rows`` are
cut into chunks by hash and dealt out as pairs of chunks, so a hot group is compared whole by many tasks and no task holds more than two
chunks.  With 21 bands of 6 numbers a pair at similarity 0.8 shares a band with probability 0.998, one at 0.9 with 1 - 2e-7.

``with_next`` reads every text beside the next one by id: texts are dealt once, by ranges of ids whose first row also goes to the
range before it, and each range is read in order; no window over all rows is needed.

Nulls: a null or empty text has no shingles, the fingerprint of the largest numbers, and likeness 1 to another such text; a null id orders
first.  Repeated rows are rows like any other (ties of an id are ordered by text).  Very long texts are read whole, in chunks of texts of
about ``CHUNK`` bytes.  Empty tables give empty results.  Other columns are ignored, also clashing ones.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.common import table, written
from ledgerline.llm.simhash import components

CHUNK = 1 << 19
MIX = np.uint64(0xBF58476D1CE4E5B9)
NONE = 0xFFFFFFFF


class MinHash:
    """Signatures of UTF-8 texts."""

    def __init__(self, permutations: int = 128, shingle: int = 5, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.shingle = shingle
        self.a = rng.integers(0, 1 << 64, permutations, np.uint64, endpoint=False) | np.uint64(1)
        self.b = rng.integers(0, 1 << 64, permutations, np.uint64, endpoint=False)
        self.place = np.cumprod(np.full(shingle, 0x9E3779B97F4A7C15, np.uint64))

    def shingles(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (64 bits) of the shingles of all texts in a row, repeats included, and how many each text has."""
        from xxhash import xxh64_intdigest

        words = [(t or b"").lower().split() for t in texts]              # bytes: ASCII letters and white space only
        number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        hashed = np.fromiter(map(xxh64_intdigest, number), np.uint64, len(number))
        size = np.fromiter(map(len, words), np.int64, len(words))
        total = int(size.sum())
        h = hashed[np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, total)] if total else np.zeros(0, np.uint64)
        n = np.where(size > 0, np.maximum(size - self.shingle + 1, 1), 0)
        first = np.repeat(np.cumsum(size) - size - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        length = np.repeat(np.minimum(size, self.shingle), n)
        out = np.zeros(len(first), np.uint64)
        for j in range(self.shingle):
            inside = j < length
            out += np.where(inside, h[np.where(inside, first + j, 0)], np.uint64(0)) * self.place[j] if total else out
        out = (out ^ (out >> np.uint64(31))) * MIX
        return out ^ (out >> np.uint64(29)), n

    def signatures(self, texts: list[bytes | None]) -> np.ndarray:
        """(texts, permutations) of uint32."""
        return self.least(*self.shingles(texts))

    def least(self, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.full((len(self.a), len(n)), NONE, np.uint32)
        some = n > 0
        if some.any():
            x = hashes >> np.uint64(32)
            starts = (np.cumsum(n) - n)[some]
            for i, (a, b) in enumerate(zip(self.a, self.b)):
                out[i, some] = np.minimum.reduceat((x * a + b) >> np.uint64(32), starts).astype(np.uint32)
        return np.ascontiguousarray(out.T)

    def bands(self, signatures: np.ndarray, rows: int) -> np.ndarray:
        """(texts, bands) of int64: a hash of each ``rows`` numbers, different for each band."""
        n = signatures.shape[1] // rows
        part = signatures[:, :n * rows].reshape(-1, n, rows).astype(np.uint64)
        h = (part * np.cumprod(np.full(rows, 0xD6E8FEB86659FD93, np.uint64))).sum(axis=2) + np.arange(n, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(32))) * MIX
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def pieces(batches, column: int):
    """Slices of Arrow batches with about CHUNK bytes of text each (or one longer text)."""
    for b in batches:
        first, held = 0, 0
        for i, t in enumerate(b.column(column)):
            held += len(t.as_buffer()) if t.is_valid else 0
            if held >= CHUNK:
                yield b.slice(first, i + 1 - first)
                first, held = i + 1, 0
        if first < b.num_rows:
            yield b.slice(first)


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", permutations: int = 128, shingle: int = 5, seed: int = 7) -> DataFrame:
    """(keys..., fingerprint): the signature of every row, as bytes (big-endian 32-bit numbers)."""
    src = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("binary").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), "fingerprint binary"])

    def run(batches):
        import pyarrow as pa

        m = MinHash(permutations, shingle, seed)
        for p in pieces(batches, len(keys)):
            sig = m.signatures(p.column(len(keys)).to_pylist()).astype(">u4")
            yield pa.RecordBatch.from_arrays([*(p.column(i) for i in range(len(keys))), pa.array([s.tobytes() for s in sig], pa.binary())], [*keys, "fingerprint"])

    return src.mapInArrow(run, schema)


# ---------------------------------------------------------------- near duplicates
def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct hashes; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(a) else 0
    return both / (len(a) + len(b) - both)


def links(sets: list[np.ndarray], bands: np.ndarray, side: np.ndarray, across: bool, threshold: float) -> list[tuple[int, int]]:
    """Verified links (indices) of one cluster that join everything its verified pairs join.  ``across``: only pairs of different ``side``."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(sets)):
        rest = np.arange(i + 1, len(sets))
        if across:
            rest = rest[side[rest] != side[i]]
        for j in rest[(bands[rest] == bands[i]).any(axis=1)].tolist():
            a, b = find(i), find(j)
            if a != b and jaccard(sets[i], sets[j]) >= threshold:
                root[b] = a
                out.append((i, j))
    return out


def near_classes(docs: DataFrame, keys: list[str], id_col: str = "doc_id", text: str = "text", threshold: float = 0.8, shingle: int = 5,
                 permutations: int = 128, rows: int = 6, seed: int = 7, cluster_rows: int = 2000) -> DataFrame:
    """(keys..., class_id): the smallest ``id_col`` that a row's text reaches over verified links (null only where all are null)."""
    twin = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    src = docs.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col(f"`{id_col}`").alias("_id"), twin.alias("_twin"),
                      F.col(f"`{text}`").cast("binary").alias("_text"))
    width = len(keys) + 2
    names = [*src.columns[:-1], "node", "bands"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), "node bigint, bands array<bigint>"])

    def mark(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        m = MinHash(permutations, shingle, seed)
        for p in pieces(batches, width):
            hashes, n = m.shingles(p.column(width).to_pylist())
            node = np.array([xxh64_intdigest(np.unique(s).tobytes()) for s in np.split(hashes, np.cumsum(n)[:-1])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(p.column(i) for i in range(width)), pa.array(node), pa.array(list(m.bands(m.least(hashes, n), rows)), pa.list_(pa.int64()))], names)

    marked = written(src.mapInArrow(mark, schema), "marked")
    nodes = written(marked.groupBy("node").agg(F.min("_id").alias("least_id"), F.min("_twin").alias("one"), F.min("bands").alias("bands")), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    stars = banded.join(banded.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1"), "band").filter("node <> least")
    clusters = written(components(stars.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()), "clusters")
    # every candidate node's text once, beside its bands and cluster (components leaves a cluster's least node out)
    member = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    chunks = member.groupBy("root").agg(F.ceil(F.count("*") / cluster_rows).cast("int").alias("chunks"))
    asked = (member.join(chunks, "root").join(nodes.select("node", "one", "bands"), "node")
             .select("node", "root", "one", "bands", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("me")))
    texts = (src.select("_twin", "_text").join(asked, F.col("_twin") == F.col("one")).groupBy("node")
             .agg(F.first("root").alias("root"), F.first("bands").alias("bands"), F.first("chunks").alias("chunks"), F.first("me").alias("me"), F.min("_text").alias("_text")))
    dealt = (texts.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
             .select("root", F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"), "me", "node", "bands", "_text"))

    def verify(groups):
        import pandas as pd

        m = MinHash(permutations, shingle, seed)
        held, at = [], None

        def out():
            sets = []
            for lo in range(0, len(held), 200):
                hashes, n = m.shingles([bytes(r[3]) for r in held[lo:lo + 200]])
                sets += [np.unique(s) for s in np.split(hashes, np.cumsum(n)[:-1])]
            found = links(sets, np.array([list(r[2]) for r in held]), np.array([r[0] for r in held]), at[1] != at[2], threshold)
            return pd.DataFrame([(held[i][1], held[j][1]) for i, j in found], columns=["a", "b"])

        for b in groups:
            for key, row in zip(zip(b.root, b.i, b.j), zip(b.me, b.node, b.bands, b._text)):
                if key != at:
                    if held:
                        yield out()
                    held, at = [], key
                held.append(row)
        if held:
            yield out()

    found = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node").mapInPandas(verify, "a bigint, b bigint")
    comp = components(found)
    rooted = written(nodes.join(comp.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", F.coalesce("root", "node").alias("root"), "least_id"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("class_id"))
    of = written(rooted.join(least, "root").select("node", "class_id"), "classes")
    return marked.join(of, "node").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "class_id")


# ---------------------------------------------------------------- each text beside the next
def ranges(docs: DataFrame, id_col: str, n: int):
    """(column: number of a row's range, rows (first id, range before it)): about ``n`` ranges of ids, at most 20,000."""
    n = max(1, min(n, 20_000))
    ident = F.col(f"`{id_col}`")
    cuts = docs.agg(F.percentile_approx(ident, [i / n for i in range(1, n)] or [1.0], F.lit(20 * n + 1000)).alias("p")).first().p or []
    cuts = sorted(set(cuts))
    bounds = F.expr("array(" + ", ".join(f"{c!r}L" if isinstance(c, int) else f"{c!r}D" for c in cuts) + ")") if cuts else None
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    number = F.lit(0)
    if cuts:                                             # binary search; a null id falls into range 0
        number = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) < ident, at + s).otherwise(at))
    firsts = sorted(docs.select(number.alias("r"), F.struct(ident.isNotNull().alias("known"), ident.alias("id")).alias("k")).groupBy("r").agg(F.min("k").alias("k")).collect(), key=lambda x: x.r)
    return number, [(f.k.id, firsts[i - 1].r) for i, f in enumerate(firsts)]


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", permutations: int = 128, shingle: int = 5, seed: int = 7) -> DataFrame:
    """Per row: id, n_chars, fingerprint, and of the text whose last half is replaced by the start of the next one (by id; after the last comes the
    first): edited_text's digest and fingerprint; the likeness of the row's fingerprint to that one and to the next row's."""
    spark = docs.sparkSession
    ident = F.col(f"`{id_col}`")
    number, firsts = ranges(docs, id_col, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[id_col].dataType
    before = F.broadcast(spark.createDataFrame(firsts, f"_first {kind.simpleString()}, _before int"))       # one row a range: 20,000 at most
    src = docs.select(ident.alias("_id"), F.col(f"`{text}`").alias("_text"), number.alias("_range"))
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_before").alias("r"), F.lit(True).alias("guest"))
    dealt = (src.join(before, F.col("_id").eqNullSafe(F.col("_first")), "left")
             .select("_id", "_text", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("x"))
             .select("x.r", "x.guest", "_id", "_text").repartition("r").sortWithinPartitions("r", "guest", "_id", "_text"))
    schema = f"_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"

    def run(batches):
        import hashlib

        import pyarrow as pa

        m = MinHash(permutations, shingle, seed)

        def out(rows):
            texts, own, after, last = [], [], [], None
            for _, t, following in rows:
                if last is None or t is not last:
                    texts.append(t)
                own.append(len(texts) - 1)
                texts.append(following)
                after.append(len(texts) - 1)
                last = following
            edited = [(t[:len(t) - len(t) // 2] + f[:len(t) // 2]).encode() for _, t, f in rows]
            sig = m.signatures([t.encode() for t in texts])
            changed = m.signatures(edited)
            mine = sig[own]
            data = lambda s: pa.array([x.tobytes() for x in s.astype(">u4")], pa.binary())
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows]).cast(b.column(2).type), pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited]), data(mine), data(changed),
                pa.array((mine == changed).mean(axis=1)), pa.array((mine == sig[after]).mean(axis=1))],
                ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        rows, size, wait = [], 0, None                   # wait: the row whose next one has not come
        for b in batches:
            for r, is_guest, i, t in zip(*(b.column(k).to_pylist() for k in range(4))):
                t = t or ""
                if wait is not None and wait[0] == r:
                    rows.append((wait[1], wait[2], t))
                    size += len(t)
                wait = None if is_guest else (r, i, t)
                if size >= CHUNK:
                    yield out(rows)
                    rows, size = [], 0
        if rows:
            yield out(rows)

    return dealt.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and their likeness."""
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return with_next(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256", hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next")


def fingerprint_classes(spark, sf_dir: str) -> DataFrame:
    """Per document: the smallest doc_id of its class of near duplicates."""
    return near_classes(table(spark, sf_dir, "documents"), ["doc_id"])
