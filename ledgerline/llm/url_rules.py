"""URL allow/block rules by a sort-merge range join (DataFrame functions only).

A host becomes a canonical key: its labels reversed, each closed by a dot (``a.example.org`` ->
``org.example.a.``).  A rule's host and all its subdomains are then one interval of keys, those that begin with the
rule's key; the paths a rule fits are one interval below its host.  Such intervals nest, so a sweep over points
and interval ends in key order keeps a stack.  A rule that opens goes on the level above those open, a rule that
ends leaves its level: the level is a running sum of +1 and -1, and the rule on a level is the last that opened there.

Two sweeps judge the URLs.  The first, over distinct hosts, gives each host the rule hosts on its stack.  The
second, over distinct (rule host, path), gives the innermost path rule of each rule host, which is its longest.  A URL costs
as many rows as rule hosts lie around its host, however many rules and paths these have.

A sweep is dealt by key range: each range is swept on its own, begins at the level that the ranges before it leave, and
takes rules that opened there from one row per range and level.

The longest rule (host and path together) wins, then the deeper host, then the rule text, then block.  A URL without a rule
gets ``default``.  A null or malformed URL (no "://") has empty host and path and no rule.  Repeated
rows and null ids stay, very long paths are compared whole, empty tables give empty results, other columns are ignored,
null rule parts count as "".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerline.llm.common import ascii_lower, table, written

#: The rules of the registered query (fixed values): verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def prefix_sweep(points: DataFrame, rules: DataFrame, innermost: bool) -> DataFrame:
    """(key, entry) for every point (distinct binary ``key``) and every rule (distinct binary ``key``, ``entry``) on the stack there, that is
    whose key the point's begins with; only the top of the stack if ``innermost``."""
    opens = rules.select("key", F.lit(1).alias("kind"), F.lit(1).alias("step"), "entry")
    ends = rules.select(F.concat("key", F.lit(bytearray(b"\xff"))).alias("key"), F.lit(0).alias("kind"), F.lit(-1).alias("step"), F.lit(None).cast(rules.schema["entry"].dataType).alias("entry"))
    seen = points.select("key", F.lit(2).alias("kind"), F.lit(0).alias("step"), F.lit(None).cast(rules.schema["entry"].dataType).alias("entry"))
    # a rule opens before a point of the same key; written once, so ranges stay as dealt
    events = written(opens.unionByName(ends).unionByName(seen).repartitionByRange("key", "kind").withColumn("part", F.spark_partition_id()), "events")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)                          # one row per range
    starts = events.groupBy("part").agg(F.sum("step").alias("net")).select("part", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = written(events.withColumn("ran", F.sum("step").over(order)).join(starts, "part")
                    .select("part", "key", "kind", "entry", (F.col("start") + F.col("ran")).alias("level")).filter("kind > 0 AND level > 0"), "swept")
    # the last rule that each range opened on each level, handed on to the ranges after it
    left = swept.filter("kind = 1").groupBy("part", "level").agg(F.max_by("entry", "key").alias("last"))
    levels = swept.select("part", "level").distinct() if innermost else swept.groupBy("part").agg(F.max("level").alias("top")).select(
        "part", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("top"))).alias("level"))
    handed = levels.join(left, ["part", "level"], "left").select(
        "part", "level", F.last("last", ignorenulls=True).over(Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("handed"))
    at = F.array("level") if innermost else F.when(F.col("kind") == 1, F.array("level")).otherwise(F.sequence(F.lit(1).cast("bigint"), F.col("level")))
    on = Window.partitionBy("part", "level").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (swept.withColumn("at", F.explode(at)).drop("level").withColumnRenamed("at", "level")
             .withColumn("open", F.last("entry", ignorenulls=True).over(on)).filter("kind = 2"))
    return found.join(handed, ["part", "level"], "left").select("key", F.coalesce("open", "handed").alias("entry"))


def rule_entries(rules: DataFrame) -> DataFrame:
    """(up, path, entry): one row per rule host (as a key) and path."""
    r = rules.select(F.lower(F.coalesce("verdict", F.lit(""))).alias("verdict"), ascii_lower(F.coalesce("host", F.lit(""))).alias("host"),
                     F.coalesce("path", F.lit("")).alias("path"))
    entry = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    return r.groupBy(key_of(F.col("host")).alias("up"), "path").agg(F.max(entry).alias("entry"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``."""
    parsed = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    entries = written(rule_entries(rules), "rules")
    bytes_of = lambda c: F.encode(c, "UTF-8")
    hosts = parsed.select("host").distinct().select("host", bytes_of(key_of(F.col("host"))).alias("key"))
    stacks = prefix_sweep(hosts.select("key"), entries.select("up").distinct().select(bytes_of(F.col("up")).alias("key"), F.col("up").alias("entry")), False)
    stacks = written(hosts.join(stacks, "key").select("host", F.col("entry").alias("up")), "stacks")
    # a byte that no text holds parts the rule host from the path
    key = F.concat(bytes_of(F.col("up")), F.lit(bytearray(b"\xfe")), bytes_of(F.col("path"))).alias("key")
    pairs = written(parsed.select("host", "path").distinct().join(stacks, "host").select("host", "path", key), "pairs")
    best = prefix_sweep(pairs.select("key").distinct(), entries.select(key, "entry"), True)
    best = written(pairs.join(best, "key").groupBy("host", "path").agg(F.max("entry").alias("best")), "best")
    return (parsed.join(best, ["host", "path"], "left")
            .select(F.col("page_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def op4_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE = r"""
WITH rules(rverdict, rhost, rpath) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
