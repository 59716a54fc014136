"""Line dedup by content-defined chunks of lines (DataFrame functions only).

A run is a multi-line run with at least ``min_words`` words, or a single line with ``alone_words`` or more.  Chunks are
cut by their content alone, and overlap: from every line the smallest run that starts there, and to every line
the smallest run that ends there.  They are the same wherever a passage stands, so every repeated run, however short its lines, is covered by
repeated chunks: those that start and end in it cover it up to the end of the last, and the smallest run to its last line
covers the rest.

A line's words bound its chunks: a chunk holds at most ``min_words`` lines with words.  Chunks that start (or end) at a line
without words reach over at most ``max_lines`` lines, so only wordless lines far from any word can stay.

Runs whose 64-bit hash occurs again anywhere in the corpus are candidates; their bytes are then compared through
their SHA-256: runs are repeated if hash and bytes agree, so texts that merely share a hash count apart.
A line is removed if any repeated run over it first stands in an earlier text (by doc_id) or earlier in its own
without overlap, whatever other runs first stand here; the line it repeats stands before it, so one copy always stays.

Only hashes and counts are shuffled to find the repeats; a run that stands in a third of all texts is
counted map-side first.  Texts are shuffled once, to meet their repeated runs.

Nulls: a null text has no lines and stays null; rows equal in doc_id and text are treated alike (a null
doc_id orders first).  Empty tables give empty results.  Other columns are ignored, also clashing ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.common import let, running_sums, table, written
from ledgerline.llm.mixing import word_count

RUN = "array<struct<at:int,n:int,h:bigint>>"


def runs_of(lines: Column, divisor: int, long_line: int, min_words: int, alone_words: int, max_lines: int = 64) -> Column:
    """Candidate runs (first line, number of lines, hash) of an array of lines.  ``divisor`` and ``long_line`` are
    not used any more: chunks need no boundary lines."""
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), word_count(x).cast("int").alias("w")))

    def with_words(a):
        whole = F.struct(F.transform(a, lambda x: x["h"]).alias("h"), F.transform(a, lambda x: x["w"]).alias("w"),
                         running_sums(F.transform(a, lambda x: x["w"])).alias("sums"),
                         running_sums(F.transform(a, lambda x: (x["w"] > 0).cast("int"))).alias("rank"),      # lines with words, up to each
                         F.filter(F.transform(a, lambda x, i: F.when(x["w"] > 0, i)), lambda i: i.isNotNull()).alias("full"))
        return let(whole, chunks)

    def chunks(t):
        size = F.size(t["h"])
        upto = lambda i: F.coalesce(F.get(t["sums"], i), F.lit(0))
        words = lambda at, end: F.get(t["sums"], end) - upto(at - 1)
        run = lambda at, n: F.struct(at.cast("int").alias("at"), n.cast("int").alias("n"), F.xxhash64(F.slice(t["h"], at + 1, n)).alias("h"))
        near = lambda first: F.transform(F.sequence(F.lit(0), F.lit(max(min_words - 1, 0))), lambda k: F.get(t["full"], first(k)))
        bounded = lambda w, n: (w > 0) | (n <= max_lines)

        def end_from(i, w):
            """Last line of the smallest run from line i (null: none)."""
            before = F.get(t["rank"], i) - (w > 0).cast("int")
            least = F.get(F.filter(near(lambda k: before + k), lambda j: words(i, j) >= min_words), F.lit(0))
            return F.when(words(i, i + 1) >= min_words, i + 1).otherwise(F.when(least.isNotNull(), F.greatest(least, i + 1)))

        def start_to(j):
            """First line of the smallest run to line j (null: none)."""
            last = F.get(t["rank"], j) - 1
            most = F.get(F.filter(near(lambda k: last - k), lambda i: words(i, j) >= min_words), F.lit(0))
            return F.when(most.isNotNull(), F.least(most, j - 1))

        def forward(w, i):
            return F.when(i + 1 < size, let(end_from(i, w), lambda e: F.when(e.isNotNull() & bounded(w, e - i + 1), run(i, e - i + 1))))

        def backward(w, j):
            # two lines are a run from their first line already, and so is a run that falls short without its last line
            def of(s):
                return F.when(s.isNotNull() & (s < j - 1) & (words(s, j - 1) >= min_words) & bounded(w, j - s + 1), run(s, j - s + 1))
            return F.when((j > 0) & (words(j - 1, j) < min_words), let(start_to(j), of))

        alone = F.transform(t["w"], lambda w, i: F.when(w >= alone_words, run(i, F.lit(1))))
        return F.filter(F.concat(F.transform(t["w"], forward), F.transform(t["w"], backward), alone), lambda r: r.isNotNull()).cast(RUN)

    return let(hashed, with_words)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", divisor: int = 2, long_line: int = 16, min_words: int = 8,
                alone_words: int = 50, max_lines: int = 64) -> DataFrame:
    """Per row: doc_id, text (without the removed lines), n_lines, n_repeated (lines in repeated runs) and
    n_removed."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("twin", F.xxhash64(F.coalesce("text", F.lit(""))))
    runs = src.select("doc_id", "twin", F.explode(runs_of(lines_of(F.col("text")), divisor, long_line, min_words, alone_words, max_lines)).alias("r")).select("doc_id", "twin", "r.*")
    # only the hashes: a run inside one text also counts when it stands there twice
    often = written(runs.groupBy("h").count().filter("count > 1").select("h"), "often")
    hits = runs.join(often, "h").groupBy("doc_id", "twin").agg(F.sort_array(F.collect_set(F.struct("at", "n", "h"))).alias("runs"))
    hits = written(hits.select(F.col("doc_id").alias("d"), F.col("twin").alias("t"), "runs"), "hits")
    met = src.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")), "left")

    lines = lines_of(F.col("text"))
    body = lambda a, r: F.array_join(F.slice(a, r["at"] + 1, r["n"]), "\n")
    digest = let(lines, lambda a: F.transform("runs", lambda r: F.struct(r["at"], r["n"], r["h"], F.sha2(body(a, r), 256).alias("bytes"))))
    # byte comparison: occurrences are grouped by hash and digest of their bytes
    seen = met.filter("runs IS NOT NULL").select("doc_id", "twin", F.explode(digest).alias("r")).select("doc_id", "twin", "r.*")
    first = F.min(F.struct("doc_id", "twin", "at"))
    groups = written(seen.groupBy("h", "bytes").agg(F.count("*").alias("n_seen"), first.alias("first")).filter("n_seen > 1"), "repeated")
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.twin") == F.col("twin")) & (F.col("at") < F.col("first.at") + F.col("n"))
    ok = (seen.join(groups.withColumnRenamed("h", "g").withColumnRenamed("bytes", "b"), (F.col("h") == F.col("g")) & (F.col("bytes") == F.col("b")))
          .select("doc_id", "twin", F.struct("at", "n", stays.alias("stays")).alias("r"))
          .groupBy("doc_id", "twin").agg(F.collect_set("r").alias("runs")))
    ok = written(ok.select(F.col("doc_id").alias("d"), F.col("twin").alias("t"), "runs"), "verified")

    def result(a):
        over = lambda runs: F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["at"], r["at"] + r["n"] - 1))))
        left = lambda gone: F.array_except(F.sequence(F.lit(0), F.size(a) - 1), gone)
        return let(F.struct(over(F.col("runs")).alias("every"), over(F.filter("runs", lambda r: ~r["stays"])).alias("gone")), lambda x: F.struct(
            F.size(a).cast("long").alias("n_lines"), F.size(x["every"]).cast("long").alias("n_repeated"), F.size(x["gone"]).cast("long").alias("n_removed"),
            F.array_join(F.transform(left(x["gone"]), lambda i: F.get(a, i)), "\n").alias("kept")))

    return (src.join(ok, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")), "left")
            .select("doc_id", "text", F.when(F.col("runs").isNotNull(), let(lines, result)).alias("x"), F.size(lines).cast("long").alias("n"))
            .select("doc_id", F.when(F.col("x").isNotNull(), F.col("x.kept")).otherwise(F.col("text")).alias("text"), F.col("n").alias("n_lines"),
                    F.coalesce("x.n_repeated", F.lit(0).cast("long")).alias("n_repeated"), F.coalesce("x.n_removed", F.lit(0).cast("long")).alias("n_removed")))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: line counts and the digest of the text that stays."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_repeated", "n_removed",
                                                                 F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
