"""SimHash near-duplicate groups by bit-sliced comparison.

1. Every text gets a 64-bit fingerprint (map side; the text is never shuffled).
2. Equal fingerprints collapse to one row, so exact copies cost nothing further.
3. The 64 bits are cut into ``blocks`` pieces.  Two fingerprints within ``radius`` bits agree
   on at least ``blocks - radius`` whole pieces, so each choice of that many pieces is a
   bucket key and every linked pair meets in some bucket (exact, nothing is missed).
4. Inside a bucket the fingerprints are stored vertically, 64 to a block: word j of a block
   holds bit j of its 64 members.  A query XORs its own bit j into word j and adds the result
   to bit-sliced counters with carries, 64 distances at once; a (query, block) pair is dropped
   as soon as all of its lanes have passed the radius.
5. Buckets above ``bucket_rows`` are cut into chunks and dealt out as pairs of chunks, so a hot
   bucket is compared whole by many tasks.
6. Each task returns a star per local group; connected components join the stars.

Nulls: a null text counts as empty; the empty text has fingerprint 0 and links like any other.
Rows with a null doc_id take part; a component whose ids are all null has a null component_id.
Repeated rows stay repeated.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.common import written

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
FLUSH = 1 << 17          # shingle hashes turned into bits at a time
SLAB = 1 << 16           # bucket rows compared at a time


# ---------------------------------------------------------------- fingerprints
def fingerprint_texts(texts, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints (uint64) of UTF-8 texts: bit j is 1 if set in over half of the shingles' XXH64."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    n_docs = len(texts)
    counts = np.zeros((n_docs, 64), np.int64)
    total = np.zeros(n_docs, np.int64)
    owners: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def flush():
        hashes = np.concatenate(parts)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        np.add.at(counts, np.array(owners), np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
        parts.clear()
        owners.clear()

    for d, text in enumerate(texts):
        words = (text or b"").lower().split()         # bytes: ASCII letters and ASCII white space only
        if not words:
            continue
        k = min(shingle, len(words))
        grams = map(b" ".join, zip(*(words[i:] for i in range(k))))
        n = len(words) - k + 1
        hashes = np.fromiter(map(digest, grams, repeat(seed)), np.uint64, n)
        total[d] = n
        for at in range(0, n, FLUSH):
            parts.append(hashes[at:at + FLUSH])
            owners.append(d)
            held += len(parts[-1])
            if held >= FLUSH:
                flush()
                held = 0
    if parts:
        flush()
    bits = (2 * counts > total[:, None]).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """(keys..., fp long) for every row of ``docs``; ``keys`` are carried along unchanged."""
    src = docs.select(*[F.col(f"`{k}`") for k in keys], F.encode(F.col(f"`{text}`"), "UTF-8").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", fp bigint"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, max(b.num_rows, 1), 512):
                part = b.slice(at, 512)
                fp = fingerprint_texts(part.column(part.num_columns - 1).to_pylist(), shingle)
                cols = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(fp.view(np.int64))], [*keys, "fp"])

    return src.mapInArrow(run, schema)


# ---------------------------------------------------------------- comparison
def masks(blocks: int, radius: int) -> list[int]:
    """A bit mask for each choice of ``blocks - radius`` of the pieces of 64 bits."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    piece = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(blocks)]
    return [sum(piece[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """(blocks, 64) words: lane l of word j of block k is bit j of fp[64 k + l]."""
    n = -(-len(fp) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")   # block, lane, bit
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8").reshape(-1, 64)


def within(planes: np.ndarray, block: np.ndarray, query: np.ndarray, lanes: np.ndarray, radius: int) -> tuple:
    """For (query, block) pairs the lanes (of those asked for) at most ``radius`` bits away.
    Returns the indices of pairs with any such lane and their lane words."""
    width = (radius + 1).bit_length()
    alive = np.arange(len(query))
    counters = [np.zeros(len(query), np.uint64) for _ in range(width)]     # bit-sliced distances
    over = ~lanes                                                          # lanes out of the race
    limit = radius + 1
    for j in range(64):
        bit = np.where((query >> np.uint64(j)) & np.uint64(1), ONES, np.uint64(0))
        carry = planes[block, j] ^ bit
        for i in range(width):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        reached = ONES
        for i in range(width):
            reached = reached & (counters[i] if limit >> i & 1 else ~counters[i])
        over = over | reached | carry
        if j % 4 == 3:
            live = over != ONES
            if not live.all():                                             # abandon blocks past the radius
                alive, block, query, over = alive[live], block[live], query[live], over[live]
                counters = [c[live] for c in counters]
                if not len(alive):
                    break
    return alive, ~over


def local_groups(fp: np.ndarray, bucket_end: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by bucket, the first row of each row's group of links inside its bucket."""
    n = len(fp)
    planes = bit_planes(fp)
    label = np.arange(n)
    row = np.arange(n)
    own = row >> 6
    last = (bucket_end - 1) >> 6
    step = 0
    while True:
        q = row[own + step <= last]
        if not len(q):
            return label
        blk = own[q] + step
        low = np.where(step == 0, (q & 63) + 1, 0)                         # only later rows of the bucket
        high = np.minimum(bucket_end[q] - (blk << 6), 64)                  # of this block
        upto = np.where(high >= 64, ONES, (np.uint64(1) << np.minimum(high, 63).astype(np.uint64)) - np.uint64(1))
        below = np.where(low >= 64, ONES, (np.uint64(1) << np.minimum(low, 63).astype(np.uint64)) - np.uint64(1))
        alive, word = within(planes, blk, fp[q], upto & ~below, radius)
        for at in range(0, len(alive), 1 << 14):
            a, w = alive[at:at + (1 << 14)], word[at:at + (1 << 14)]
            hit, lane = np.nonzero(np.unpackbits(w.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            label = merged(label, q[a[hit]], (blk[a[hit]] << 6) + lane)
        step += 1


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest row of the group) after adding the links a-b."""
    while True:
        la, lb = label[a], label[b]
        diff = la != lb
        if not diff.any():
            return label
        a, b, la, lb = a[diff], b[diff], la[diff], lb[diff]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def stars(batches, radius: int):
    """Rows (bucket columns..., fp) sorted by bucket -> (a, b) links from each row to its group's first row."""
    import pyarrow as pa

    def work(table):
        fp = table.column(table.num_columns - 1).to_numpy().view(np.uint64)
        new = np.zeros(len(fp), bool)
        new[0] = True
        for i in range(table.num_columns - 1):
            c = table.column(i).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(fp))
        bucket_end = np.repeat(end, end - start)
        label = local_groups(fp, bucket_end, radius)
        moved = np.flatnonzero(fp[label] != fp)
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], ["a", "b"]), int(start[-1])

    held = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= SLAB:
            whole = pa.Table.from_batches(held).combine_chunks()
            cut = last_bucket(whole)
            if cut:
                yield work(whole.slice(0, cut).combine_chunks())[0]
                rest = whole.slice(cut).combine_chunks()
                held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield work(pa.Table.from_batches(held).combine_chunks())[0]


def last_bucket(t) -> int:
    """Where the last bucket of a sorted table begins."""
    same = np.ones(t.num_rows, bool)
    for i in range(t.num_columns - 1):
        c = t.column(i).to_numpy()
        same &= c == c[-1]
    return int(np.flatnonzero(same)[0])


def links(fps: DataFrame, radius: int = 3, blocks: int = 5, bucket_rows: int = 4096) -> DataFrame:
    """Links (a, b) whose components equal those of all pairs of ``fps`` (column fp, distinct)
    at most ``radius`` bits apart.  ``blocks`` sets only how candidates meet (more blocks: more,
    smaller buckets), ``bucket_rows`` how hot buckets are dealt; neither changes the components."""
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("k"))
                     for i, m in enumerate(masks(blocks, radius))])
    rows = fps.select("fp", F.explode(keys).alias("x")).select("x.c", "x.k", "fp")
    hot = written(rows.groupBy("c", "k").count().filter(F.col("count") > bucket_rows)
                  .select("c", "k", F.ceil(F.col("count") / bucket_rows).cast("int").alias("chunks")), "hot")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = (rows.join(hot, ["c", "k"], "left")
             .select("c", "k", "fp", F.coalesce("chunks", F.lit(1)).alias("chunks"), F.coalesce(mine, F.lit(0)).alias("me"))
             .select("c", "k", "fp", "me", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
             .select("c", "k", F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"), "fp"))
    return (dealt.repartition("c", "k", "i", "j").sortWithinPartitions("c", "k", "i", "j")
            .mapInArrow(lambda it: stars(it, radius), "a bigint, b bigint").distinct())


# ---------------------------------------------------------------- components
def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable.  Alternates the large-star and
    small-star steps; only counts and sums reach the driver."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", "m")).filter("u <> v").distinct())
        e = written(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        before = now
    raise RuntimeError("components did not settle")


def simhash_groups(docs: DataFrame, keys: list[str], id_col: str = "doc_id", text: str = "text", shingle: int = 3,
                   radius: int = 3, blocks: int = 5, bucket_rows: int = 4096) -> DataFrame:
    """(keys..., fp, root, component_id): ``root`` names the group, ``component_id`` is the smallest ``id_col`` reachable over links of at most
    ``radius`` differing bits, for every row."""
    marked = written(fingerprints(docs, keys, text, shingle), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min(f"`{id_col}`").alias("least_id")), "classes")
    comp = components(links(classes.select("fp"), radius, blocks, bucket_rows))
    rooted = written(classes.join(comp, classes["fp"] == comp["node"], "left")
                     .select("fp", F.coalesce("root", "fp").alias("root"), "least_id"), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = written(rooted.join(ids, "root").select("fp", "root", "component_id"), "components")
    return marked.join(of, "fp").select(*[F.col(f"`{k}`") for k in keys], "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group, the one with the smallest ``id_col`` (null last), with its columns.
    Rows equal in id and text are one group; one of them stays."""
    twin = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    whole = docs.select(F.col(f"`{id_col}`").alias("id"), twin.alias("twin"), F.col(f"`{text}`").alias("text"),
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))      # a struct: no name can clash
    groups = simhash_groups(whole.select("id", "twin", "text"), ["id", "twin"], "id", "text", **options)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "twin"))
    keep = written(groups.groupBy("root").agg(first.alias("k")).select(F.col("k.id").alias("kept_id"), F.col("k.twin").alias("kept_twin")), "kept")
    rows = whole.join(keep, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("twin") == F.col("kept_twin")), "left_semi")
    return rows.dropDuplicates(["id", "twin"]).select("row.*")


def hex16(c):
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs, ["doc_id"]).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
