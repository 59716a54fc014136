"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size (words of its documents).  The budget is shared by weight; a
source whose share passes ``max_epochs`` times its size is clamped there and the excess is reshared
by weight among the others until none is above.  The ratio target / size is then taken from each
document: its whole part as full repetitions of every document, its fraction as one more repetition
of a seeded choice of documents.  The choice orders a source's documents by a seeded hash of
doc_id and takes the front of that order whose size comes nearest to the wanted fraction, so a
source misses its target by about half a document and reruns agree.

The cut in hash order is found by counting: sizes per hash prefix (4096 each), then per longer
prefix inside the prefix that holds the cut, then row by row in what is left; a hot source is never
sorted or gathered.  Rows with one doc_id share a hash and are taken or left together.

Nulls: a null source is a source of its own, last; a null or empty text has size 0; a null doc_id
hashes like "".  Repeated rows count each time.  An empty table, or one without words, takes nothing.
Very long texts are counted whole; ties of the hash order by doc_id.  Other columns are ignored, also clashing ones.
Only one row per source is collected or broadcast-sized.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.llm.common import SPACE, table, written

PREFIX = 3          # hash digits (hex) per counting step
CYCLE = (3, 1, 2)   # weights of the registered query, repeating


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    parts = F.size(F.split(F.coalesce(text, F.lit("")), SPACE))
    edges = F.coalesce(text, F.lit(""))
    return (parts - edges.rlike(r"^[\x20\x09-\x0D]").cast("int") - edges.rlike(r"(^|[\x20\x09-\x0D])\z").cast("int")).cast("long")


def seeded_hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))


def cyclic_weights(sources: DataFrame, cycle=CYCLE) -> DataFrame:
    """(source, weight): the cycle dealt to the distinct sources in code-point order, null last.
    The window holds one row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (rank % len(cycle)).cast("int") + 1).alias("weight"))


def water_fill(sizes: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """``sizes`` (source, size, weight) with target.  Each round is one small aggregate; sources
    only ever become clamped, so there are at most as many rounds as sources."""
    cap = F.col("size") * F.lit(float(max_epochs))
    level = -1.0                                         # target per weight of the sources not clamped
    while True:
        clamped = cap <= F.col("weight") * F.lit(level)
        used, free = sizes.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight")))).first()
        if not free:
            break
        new = (total - (used or 0.0)) / free
        if new == level:
            break
        level = new
        if sizes.filter(~clamped & (cap <= F.col("weight") * F.lit(level))).isEmpty():
            break
    return sizes.withColumn("target", F.least(cap, F.col("weight") * F.lit(max(level, 0.0))))


def cuts(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, cut): documents with hash <= cut are taken; null takes none.
    ``docs``: source, size, h.  ``goals``: source, goal (words wanted in front)."""
    state = goals.select("source", "goal", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for step in range(2):
        n = PREFIX * (step + 1)
        here = (docs.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & F.col("h").startswith(F.col("prefix")))
                .groupBy("source", "goal", "before", F.substring("h", 1, n).alias("p")).agg(F.sum("size").alias("size")))
        w = Window.partitionBy("source").orderBy("p")    # 4096 rows a source at most
        upto = F.col("before") + F.sum("size").over(w)
        marked = here.select("source", "goal", "p", "size", upto.alias("upto"))
        # the first prefix that reaches the goal; the last one where none does
        pick = F.min(F.struct((F.col("upto") < F.col("goal")).alias("short"), F.when(F.col("upto") < F.col("goal"), -F.col("upto")).otherwise(F.col("upto")).alias("o"),
                              "p", (F.col("upto") - F.col("size")).alias("before")))
        state = written(marked.groupBy("source", "goal").agg(pick.alias("x")).select("source", "goal", F.col("x.p").alias("prefix"), F.col("x.before").alias("before")), "cut")
    rest = (docs.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & F.col("h").startswith(F.col("prefix")))
            .groupBy("source", "goal", "prefix", "before", "h").agg(F.sum("size").alias("size")))
    w = Window.partitionBy("source").orderBy("h")
    row = rest.select("source", "goal", "h", "prefix", "before", (F.col("before") + F.sum("size").over(w)).alias("upto"))
    tried = row.select("source", F.abs(F.col("upto") - F.col("goal")).alias("off"), F.col("h").alias("cut")).union(
        row.select("source", F.abs(F.col("before") - F.col("goal")).alias("off"), F.col("prefix").alias("cut")))
    return tried.groupBy("source").agg(F.min(F.struct("off", "cut"))["cut"].alias("cut"))


def mix(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, seed: int = 7, weights: DataFrame | None = None,
        id_col: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Returns (docs, plan).  docs: (doc_id, source, size, h) rows, one per input row; plan: one row per
    source (source, source_size, weight, target, whole, cut).  ``weights`` (source, weight) or the cycle;
    a source that ``weights`` leaves out has weight 0.  A document is repeated ``whole`` times, once more
    if h <= cut: see ``repetitions``."""
    sized = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                                word_count(F.col(f"`{text}`")).alias("size"), seeded_hash(id_col, seed).alias("h")), "sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("size"))
    given = cyclic_weights(per) if weights is None else weights.select("source", F.col("weight").cast("double").alias("weight"))
    sizes = written(per.join(given.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
                    .select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight")), "sources")
    total = share * (sizes.agg(F.sum("size")).first()[0] or 0)
    filled = water_fill(sizes, total, max_epochs)
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0))
    plan = written(filled.select("source", F.col("size").alias("source_size"), "weight", "target", F.floor(ratio).cast("int").alias("whole")), "plan")
    goals = plan.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("goal")).filter("goal > 0")
    cut = cuts(sized, goals)
    plan = written(plan.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "cuts")
    return sized, plan


def repetitions(whole: Column, cut: Column, h: Column) -> Column:
    return whole + F.when(h <= cut, 1).otherwise(0)


def mixed(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (not at all, once, twice ...)."""
    _, plan = mix(docs, seed=seed, id_col=id_col, source=source, **options)
    p = plan.select("source", "whole", "cut")
    whole = docs.select(F.col(f"`{source}`").alias("s"), seeded_hash(id_col, seed).alias("h"),
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))      # a struct: no name can clash
    times = repetitions(F.col("whole"), F.col("cut"), F.col("h"))
    return (whole.join(p, F.col("s").eqNullSafe(F.col("source"))).select("row", F.explode(F.array_repeat(F.lit(0), times)))
            .select("row.*"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    sized, plan = mix(table(spark, sf_dir, "documents"))
    return (sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "size", "source_size", "target",
                    (F.col("size") * repetitions(F.col("whole"), F.col("cut"), F.col("h"))).cast("long").alias("taken")))


#: The cap binds where 2 size <= level * weight; sources sorted by size / weight clamp from the front.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
w AS (SELECT source, size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
o AS (SELECT *, coalesce(sum(2.0 * size) OVER f, 0)::DOUBLE AS used, (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS free,
    row_number() OVER (ORDER BY size / weight, source NULLS LAST) AS k, (1.5 * sum(size) OVER ())::DOUBLE AS total
    FROM w WINDOW f AS (ORDER BY size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min_by((total - used) / free, k) AS level FROM o WHERE 2.0 * size > (total - used) / free * weight),
t AS (SELECT source, size AS source_size, least(2.0 * size, level * weight)::DOUBLE AS target FROM w, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS whole FROM t),
h AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
c AS (SELECT h.source, h.h, sum(h.size) OVER (PARTITION BY h.source ORDER BY h.h) AS upto, g.target - g.whole * g.source_size AS goal
    FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source WHERE g.target - g.whole * g.source_size > 0),
x AS (SELECT source, h AS cut, abs(upto - goal) AS off FROM c UNION ALL SELECT source, '' AS cut, max(goal) AS off FROM c GROUP BY source),
b AS (SELECT source, min({'off': off, 'cut': cut}).cut AS cut FROM x GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN h <= cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
