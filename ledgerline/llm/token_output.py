"""Token-ID output: fixed-width bit-packed ids in blocks.

File format: a folder of Parquet shards, written with Spark's own commit protocol (a lost
executor's half-written shard never counts).  Each row is a block of at most ``block_ids`` ids:
``shard`` (order of the shards), ``block`` (order in the shard), ``bits`` (ceil(log2 V)),
``n_ids``, ``payload`` (ids packed ``bits`` wide, least significant bit first), and the block's
offsets: ``doc_ids``, ``doc_starts`` and ``doc_lengths`` of the documents that begin in the block,
``doc_starts`` counted in ids from the start of the shard.  Blocks of a shard are full except
the last, so id i of a shard lies in block i // block_ids: random access needs no scan, and a
block unpacks with a few numpy operations.

Nulls: a null text is empty and holds only the end id; a null doc_id sorts first.  Repeated rows
are written repeatedly.  An empty table gives an empty folder.  Other columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerline.llm.common import scratch, written

BLOCK_IDS = 1 << 16
CACHE_WORDS = 600_000
SIGNS = frozenset([b".", b",", b";", b":", b"!", b"?", b"|"])
#: Words the tokenizer's normalizer only lower-cases: visible ASCII and Latin-1, dashes, quotes and the like.
PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u00ff\u2010-\u2027\u2030-\u205e]+")
#: The pieces its pre-tokenizer cuts them into: endings, letters, single digits, other signs.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|"
                    "[^a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff0-9\u00b2\u00b3\u00b9\u00bc-\u00be]+")
#: A byte-level vocabulary's signs for the bytes that have no visible Latin-1 character of their own.
BYTE_SIGNS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
FORMAT = ("shard int, block int, bits int, n_ids int, payload binary, doc_ids array<bigint>, "
          "doc_starts array<bigint>, doc_lengths array<bigint>")


def id_bits(vocabulary: int) -> int:
    """The fewest bits that hold every id of the vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (uint32) side by side, ``bits`` each, least significant bit first.  64 ids fill exactly
    ``bits`` words of 64 bits, so lane j of every group of 64 lands in the same word and shift."""
    lanes = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(lanes), bits), np.uint64)
    for j in range(64):
        w, s = divmod(j * bits, 64)
        words[:, w] |= lanes[:, j] << np.uint64(s)
        if s + bits > 64:
            words[:, w + 1] |= lanes[:, j] >> np.uint64(64 - s)
    return words.astype("<u8").tobytes()[: -(-len(ids) * bits // 8)]


def unpack(payload: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """Ids first .. first + n - 1 of a block, reading only the groups of 64 ids that hold them."""
    head, stop = first // 64, -(-(first + n) // 64)
    raw = payload[head * bits * 8: stop * bits * 8]
    words = np.frombuffer(raw + bytes((stop - head) * bits * 8 - len(raw)), "<u8").reshape(stop - head, bits)
    lanes = np.empty((stop - head, 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        w, s = divmod(j * bits, 64)
        lane = words[:, w] >> np.uint64(s)
        if s + bits > 64:
            lane = lane | words[:, w + 1] << np.uint64(64 - s)
        lanes[:, j] = lane & mask
    return lanes.reshape(-1)[first - head * 64: first - head * 64 + n]


class WordIds(dict):
    """word -> its ids as little-endian uint32 bytes.  A tokenizer that drops white space encodes a text as
    the concatenation of its words, so frequent words are encoded once per worker.  A full cache becomes
    the older generation, from which words still in use come back without being encoded again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = self.encoded(word)
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = got
        return got

    def encoded(self, word: bytes) -> bytes:
        core = word.lower()
        if core.isalpha():                               # ASCII letters are one piece: only the merges are needed
            return self.merged(core.decode()) if core == word else self[core]
        rest = core[:-1]
        if core[-1:] in SIGNS and (rest.isalpha() or rest.decode().lower()[-1:].isalpha()):   # a sign after a letter is encoded apart
            return self[word[:-1]] + self[word[-1:]]
        text = word.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:   # cut here, pieces met before are not encoded again; special ids begin with <|
            pieces = PIECES.findall(text.lower())
            if len(pieces) > 1:
                return b"".join([self[p.encode()] for p in pieces])
            return self.merged(pieces[0].encode().decode("latin-1").translate(BYTE_SIGNS))
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tok.model.tokenize(piece)]).tobytes()


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def encode_text(text: bytes | None, words: WordIds) -> bytes:
    """The ids of a whole UTF-8 text, as little-endian uint32 bytes.  Only ASCII white space
    splits words here; the tokenizer itself deals with any other."""
    return b"".join(map(words.__getitem__, (text or b"").split()))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int, end_id: int = 1,
                 id_col: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write the packed shards to ``path`` in ascending ``id_col`` order."""
    bits = id_bits(max(vocabulary, end_id + 1))
    end = np.array([end_id], "<u4").tobytes()
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8").alias("text"))
    ordered = src.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def shard(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        words = word_ids(tokenizer_path)
        buffer = bytearray()
        starts: list[tuple] = []
        at = block = 0                                   # ids written to the shard so far, blocks given out

        def out(n):
            nonlocal block, starts
            head = (block + 1) * block_ids
            mine = [s for s in starts if s[1] < head]
            starts = starts[len(mine):]
            row = {"shard": [number], "block": [block], "bits": [bits], "n_ids": [n],
                   "payload": [pack(np.frombuffer(bytes(buffer[: 4 * n]), "<u4"), bits)],
                   "doc_ids": [[s[0] for s in mine]], "doc_starts": [[s[1] for s in mine]], "doc_lengths": [[s[2] for s in mine]]}
            del buffer[: 4 * n]
            block += 1
            return pa.RecordBatch.from_pydict(row, schema=SCHEMA())

        for b in batches:
            for one in range(b.num_rows):
                ids = encode_text(b.column(1)[one].as_py(), words) + end
                starts.append((b.column(0)[one].as_py(), at, len(ids) // 4))
                at += len(ids) // 4
                buffer += ids
                while len(buffer) >= 4 * block_ids:
                    yield out(block_ids)
        if buffer:
            yield out(len(buffer) // 4)

    ordered.select("id", "text").mapInArrow(shard, FORMAT).write.parquet(path)


def SCHEMA():
    import pyarrow as pa

    return pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("bits", pa.int32()), ("n_ids", pa.int32()), ("payload", pa.binary()),
                      ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64()))])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORMAT).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, shard, at (first id in the shard), start (ids of all
    documents before it), n_tokens.  Only block lengths (a row per shard) are summed in one place."""
    blocks = read_blocks(spark, path)
    totals = blocks.groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("n"))
    base = written(totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base")), "bases")
    docs = blocks.select("shard", F.explode(F.arrays_zip("doc_ids", "doc_starts", "doc_lengths")).alias("d"))
    return docs.join(base, "shard").select(F.col("d.doc_ids").alias("doc_id"), "shard", F.col("d.doc_starts").alias("at"),
                                           (F.col("base") + F.col("d.doc_starts")).alias("start"), F.col("d.doc_lengths").alias("n_tokens"))


def read_checksums(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 of its unpacked ids.

    A document that runs over several blocks is checked in pieces: each block returns the CRC of
    its part, and a fold over the pieces (one small row each) combines them in order."""
    blocks = read_blocks(spark, path)
    index = read_index(spark, path)
    cut = (index.withColumn("b", F.explode(F.sequence(F.expr(f"at div {block_ids}"), F.expr(f"(at + n_tokens - 1) div {block_ids}"))))
           .select("shard", F.col("b").cast("int").alias("block"), "doc_id", "start", "n_tokens",
                   F.greatest(F.lit(0), F.expr(f"at - b * {block_ids}")).cast("int").alias("first"),
                   F.least(F.lit(block_ids), F.expr(f"at + n_tokens - b * {block_ids}")).cast("int").alias("stop")))
    parts = cut.groupBy("shard", "block").agg(F.sort_array(F.collect_list(F.struct("start", "doc_id", "n_tokens", "first", "stop"))).alias("parts"))
    joined = blocks.select("shard", "block", "bits", "n_ids", "payload").join(parts, ["shard", "block"]).select("block", "bits", "n_ids", "payload", "parts")

    def check(batches):
        import zlib

        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                block, bits, n, payload, rows = (b.column(k)[i].as_py() for k in range(5))
                ids = unpack(payload, bits, 0, n)
                got = []
                for r in rows:
                    raw = ids[r["first"]:r["stop"]].tobytes()
                    got.append((r["doc_id"], r["start"], r["n_tokens"], block, len(raw), zlib.crc32(raw)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], ["doc_id", "start", "n_tokens", "block", "size", "crc"])

    done = written(joined.mapInArrow(check, "doc_id bigint, start bigint, n_tokens bigint, block bigint, size bigint, crc bigint"), "sums")
    whole = done.filter("size = 4 * n_tokens").select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    pieces = (done.filter("size < 4 * n_tokens").groupBy("doc_id", "start", "n_tokens")
              .agg(F.sort_array(F.collect_list(F.struct("block", "size", "crc"))).alias("p")))

    def fold(batches):
        for b in batches:
            yield b.assign(ids_crc32=[combined_crc((x["block"], x["size"], x["crc"]) for x in p) for p in b.p]).drop(columns="p")

    return whole.unionByName(pieces.mapInPandas(fold, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def combined_crc(pieces) -> int:
    """CRC-32 of the concatenation of pieces given as (block, size, crc) in block order."""
    total = 0
    for _, size, crc in pieces:
        total = shifted_crc(total, size) ^ crc
    return total


def shifted_crc(crc: int, size: int) -> int:
    """The CRC's contribution after ``size`` more bytes: multiplication by x^(8 size) modulo the
    CRC-32 polynomial, by squaring."""
    poly = 0xEDB88320                                   # fixed value: the reflected CRC-32 polynomial

    def times(a: int, b: int) -> int:
        out = 0
        for i in range(31, -1, -1):                     # reflected: bit 31 is x^0
            if a >> i & 1:
                out ^= b
            b = (b >> 1) ^ (poly if b & 1 else 0)
        return out

    power, base, n = 1 << 31, 1 << 23, size             # 1, and x^8
    while n:
        if n & 1:
            power = times(power, base)
        base = times(base, base)
        n >>= 1
    return times(power, crc)


def vocabulary_size(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_table(docs: DataFrame) -> DataFrame:
    """Encode, write, read back: the digest columns of the written files."""
    spark = docs.sparkSession
    where, tokenizer = scratch(spark, "tokens"), default_tokenizer()
    write_tokens(docs, where, tokenizer, vocabulary_size(tokenizer))
    return read_checksums(spark, where)


def op1_token_output(spark, sf_dir: str) -> DataFrame:
    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
