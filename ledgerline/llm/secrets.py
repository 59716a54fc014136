"""Secret scans with multipart credential linking (DataFrame functions only).

Base spans: assignments, access identifiers and hex runs, each found leftmost and non-overlapping
in the whole text.  Offsets come from cutting the text at the matches: pieces and matches alternate,
so their running lengths (code points) are the spans.

The method adds weak candidates that mean little alone: account names (``user``), short assigned
values (``weak``, 6 to 11 characters) and endpoints (``url``, ``ip``).  Each part has a role:
identifier (access, user), secret (assign, hex, weak) or endpoint (url, ip).  A weak candidate is
reported only if parts of both other roles lie within its scope, ``scope`` code points between the
starts.  The scopes are joined as intervals: parts meet by (document, bucket of ``scope`` code
points), a part looks into its own bucket and the two beside it, and the distance is checked.  Only
spans (not texts) are shuffled, and only those of documents in which all three roles occur; a bucket
holds at most ``scope`` starts, so no document, however long, makes all pairs.

Nulls: a null text is empty, with no spans; a null doc_id is kept.  Rows equal in doc_id and text
share one link computation and stay repeated.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.common import let, running_sums, table, written

#: Base patterns and least lengths (fixed values).
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: Weak candidates of the method.
USER = r"""\b(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
URL = r"""\b(?:https?|postgres|mysql|redis|amqp|ftp)://[^\x20\x09-\x0D"'<>]{4,}"""
IP = r"""\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"""
KINDS = ("assign", "access", "hex", "user", "weak", "url", "ip")     # order at equal starts
ROLE = {"assign": "secret", "hex": "secret", "weak": "secret", "access": "identifier", "user": "identifier", "url": "endpoint", "ip": "endpoint"}
SCOPE = 300


def spans_of(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans (start, rank, end, kind) of the matches that ``keep`` accepts."""
    rank = KINDS.index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def build(m):
        pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        size = F.transform(m, lambda x: F.length(x))

        steps = F.zip_with(size, F.slice(pieces, F.lit(1), F.size(m)), lambda n, p: n + p)
        # a match starts where the sum of all pieces and matches up to it ends, less its own length
        starts = let(running_sums(steps), lambda upto: F.zip_with(upto, size, lambda u, n: u - n))
        return let(starts, lambda st: F.filter(
            F.zip_with(m, st, lambda x, s: F.struct(s.alias("s"), F.lit(rank).alias("r"), (s + F.length(x)).alias("e"), F.lit(kind).alias("k"), keep(x).alias("ok"))),
            lambda x: x["ok"]))

    none = F.array().cast("array<struct<s:int,r:int,e:int,k:string,ok:boolean>>")
    return F.when(text.rlike(pattern), let(found, build)).otherwise(none)


def value_length(match: Column) -> Column:
    return F.length(F.regexp_replace(match, ASSIGN_HEAD, ""))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: id, base (array of spans s, r, e, k by start and kind) and spans (base and linked weak ones)."""
    body = F.coalesce(F.col("text"), F.lit(""))
    always = lambda x: F.lit(True)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts = src.select(
        "doc_id", F.xxhash64(body).alias("twin"),
        spans_of(body, ASSIGN, "assign", lambda x: value_length(x) >= 12).alias("assign"),
        spans_of(body, ASSIGN, "weak", lambda x: value_length(x).between(6, 11)).alias("weak"),
        spans_of(body, ACCESS, "access", lambda x: F.length(x) >= 18).alias("access"),
        spans_of(body, HEX, "hex", always).alias("hex"), spans_of(body, USER, "user", always).alias("user"),
        spans_of(body, URL, "url", always).alias("url"), spans_of(body, IP, "ip", always).alias("ip"))
    shape = "array<struct<s:int,r:int,e:int,k:string>>"
    clean = lambda *names: F.sort_array(F.transform(F.concat(*names), lambda x: F.struct(x["s"], x["r"], x["e"], x["k"])).cast(shape))
    base = written(parts.select("doc_id", "twin", clean("assign", "access", "hex").alias("base"), clean("user", "weak", "url", "ip").alias("weak")), "spans")

    has = lambda names, *kinds: F.exists(names, lambda x: x["k"].isin(*kinds))
    every = F.concat("base", "weak")
    linkable = (base.filter(has("weak", "user", "weak", "url", "ip") & has(every, "access", "user") & has(every, "assign", "hex", "weak") & has(every, "url", "ip"))
                .select("doc_id", "twin", every.alias("all")).distinct())
    part = linkable.select("doc_id", "twin", F.explode("all").alias("x")).select("doc_id", "twin", "x", F.floor(F.col("x.s") / scope).alias("bucket"))
    role = F.create_map(*[F.lit(v) for kv in ROLE.items() for v in kv])
    weak = (part.filter(F.col("x.r") >= KINDS.index("user"))
            .select("doc_id", "twin", F.col("x").alias("w"), F.explode(F.array(*[F.col("bucket") + i for i in (-1, 0, 1)])).alias("bucket")))
    near = (weak.join(part.withColumnRenamed("doc_id", "d").withColumnRenamed("twin", "t").withColumnRenamed("bucket", "b"),
                      F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")) & (F.col("bucket") == F.col("b")))
            .filter((F.abs(F.col("w.s") - F.col("x.s")) <= scope) & (role[F.col("w.k")] != role[F.col("x.k")])))
    linked = (near.groupBy("doc_id", "twin", "w").agg(F.count_distinct(role[F.col("x.k")]).alias("roles")).filter("roles = 2")
              .groupBy("doc_id", "twin").agg(F.collect_list("w").alias("linked")))
    linked = written(linked.select(F.col("doc_id").alias("d"), F.col("twin").alias("t"), "linked"), "linked")
    return (base.join(linked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")), "left")
            .select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast(shape)))).alias("spans")))


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
