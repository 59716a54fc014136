"""Quality rules: a threshold table compiled into one projection (no user functions).

``measures`` computes the counts of a text once, ``RULES`` names ratios of them with bounds, and
``compiled`` turns the table into one boolean expression, so a document is judged in the scan that
reads it: no shuffle, no join, nothing gathered.

Counts of words in repeated 3-word windows: the windows' hashes are sorted with their positions,
neighbours with equal hashes mark repeated windows (64-bit XXH64 of the three words), and the
positions those windows cover are counted once each; n log n in the words of one text.

Nulls: a null text has no words (all counts 0, base_failed, not kept).  Long texts are read whole.
Repeated rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.common import SPACE, let, split_words, table

#: Common short words of four languages (fixed values; a text in any of them has some).
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "be", "with", "it", "for", "on", "de", "la", "le", "et", "les", "des", "que",
              "un", "une", "el", "los", "las", "en", "por", "para", "der", "die", "das", "und", "von", "den", "ist", "nicht", "zu"]

#: rule: (numerator, denominator, least, most); a null bound is open.  Ratios over 0 count as 0.
RULES = {
    "mean_word_length": ("word_chars", "n_words", 2.0, 12.0),
    "symbols_per_word": ("n_symbols", "n_words", None, 0.1),
    "duplicate_lines": ("n_dup_lines", "n_lines", None, 0.3),
    "stop_words": ("n_stop_words", "n_words", 0.02, None),
    "upper_words": ("n_upper_words", "n_words", None, 0.3),
    "ellipsis_lines": ("n_ellipsis_lines", "n_lines", None, 0.3),
}


def repeated_positions(words: Column) -> Column:
    """How many words lie in 3-word windows found at least twice."""
    windows = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2)).alias("h"), i.alias("i")))
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))

    def covered(s):
        again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        at = F.sort_array(F.transform(again, lambda x: x["i"]))
        # a window starting g words after the previous one adds min(g, 3) words; the first adds 3
        return let(at, lambda a: F.aggregate(F.transform(a, lambda p, k: F.least(F.lit(3), F.coalesce(p - F.get(a, k - 1), F.lit(3)))),
                                             F.lit(0).cast("long"), lambda acc, x: acc + x))

    return let(F.sort_array(windows), covered)


def measures(text: Column) -> Column:
    """A struct of the counts that rules and the digest use."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])

    def of_words(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_positions(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.array_contains(stop, F.lower(F.rtrim(x, F.lit(".,;:!?")))))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: (F.length(x) > 1) & x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}"))).cast("long").alias("n_upper_words"))

    def of_lines(x):
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                        F.size(F.filter(x, lambda s: s.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"))

    return F.struct(let(split_words(body), of_words).alias("w"), let(lines, of_lines).alias("l"),
                    F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
                    F.length(F.regexp_replace(body, r"[^#*$%&|<>]", "")).cast("long").alias("n_symbols"))


def compiled(rules: dict) -> Column:
    """All rules as one boolean expression."""
    ok = F.lit(True)
    for numerator, denominator, least, most in rules.values():
        ratio = F.coalesce(F.col(numerator) / F.nullif(F.col(denominator), F.lit(0)), F.lit(0.0))
        if least is not None:
            ok = ok & (ratio >= least)
        if most is not None:
            ok = ok & (ratio <= most)
    return ok


def judged(docs: DataFrame, keys: list[str], text: str = "text", rules: dict | None = None) -> DataFrame:
    """keys..., the counts, base_failed and kept for every row."""
    counted = docs.select(*[F.col(f"`{k}`") for k in keys], measures(F.col(f"`{text}`")).alias("_m"))
    flat = counted.select(*[F.col(f"`{k}`") for k in keys], "_m.w.*", "_m.l.*", "_m.word_chars", "_m.n_symbols")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return flat.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compiled(rules or RULES))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: list_contains([STOP], lower(rtrim(x, '.,;:!?'))))) AS n_stop,
    len(list_filter(ws, lambda x: length(x) > 1 AND regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}'))) AS n_upper,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ell
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / n_words <= 0.1 AND n_dup_lines / n_lines <= 0.3
  AND n_stop / n_words >= 0.02 AND n_upper / n_words <= 0.3 AND n_ell / n_lines <= 0.3 AS kept FROM b
""".replace("STOP", ", ".join(f"'{w}'" for w in STOP_WORDS))
