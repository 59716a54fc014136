"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression (Spark ML, features computed in the scan) gives each document's own evidence.
Documents belong to a host and, below it, a path; grouped aggregates of the document probabilities
give the share of good documents of each, shrunk towards the level above:

    host posterior = (sum p + k_host * global) / (n + k_host)
    path posterior = (sum p + k_path * host posterior) / (n + k_path)

The strengths k come from the spread of the shares between hosts (paths) by the method of moments, so
sites with few documents stay near their host and sparse hosts near the global share.  A document's own
probability is taken out of its sites' sums (leave one out).  The final log-odds are the document's
plus ``site_weight`` times those of its path posterior against the global share; it is kept at
``threshold`` and above.

Fitting uses at most ``max_labelled`` labelled rows (smallest seeded hash); everything else covers all
rows.  Sites meet documents in a join on host and path whose small side Spark broadcasts only under its
threshold; a hot host is combined map-side.

Nulls: null labels are not used; a null host or path is a site of its own; a null text is empty.  Without both
classes among the labels the document evidence is flat.  Repeated rows are judged alike.  Empty tables
give empty results.  Other columns are ignored (``keep_good`` returns them as they are).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.common import let, split_words, table, written

FEATURES = ("log_words", "mean_length", "distinct", "symbols", "pipes", "upper", "marks", "digits")


def features(text: Column) -> Column:
    """A struct of document features: ratios over words or characters."""
    body = F.coalesce(text, F.lit(""))
    left = lambda keep: F.length(F.regexp_replace(body, keep, "")).cast("double")

    def of(w):
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        upper = F.size(F.filter(w, lambda x: (F.length(x) > 1) & (F.upper(x) == x) & (F.lower(x) != x)))
        return F.struct(F.log1p(F.size(w).cast("double")).alias("log_words"), F.least(F.length(body) / n, F.lit(40.0)).alias("mean_length"),
                        (F.size(F.array_distinct(w)) / n).alias("distinct"), F.least(left(r"[^#*$%&<>]") / n, F.lit(4.0)).alias("symbols"),
                        F.least(left(r"[^|]") / n, F.lit(4.0)).alias("pipes"), (upper / n).alias("upper"),
                        F.least(left(r"[^!?]") / n, F.lit(4.0)).alias("marks"), F.least(left(r"[^0-9]") / n, F.lit(4.0)).alias("digits"))

    return let(split_words(body), of)


def fit_document_model(rows: DataFrame, labels: DataFrame, id_col: str, label: str, max_labelled: int, seed: int) -> tuple[list[float], float]:
    """(coefficients, intercept) over FEATURES; ``rows`` has id and the features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    known = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label}`").cast("double").alias("label")).filter("label IS NOT NULL AND i IS NOT NULL")
    some = written(known.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string"))), "label").limit(max_labelled), "labelled")
    data = written(rows.join(some, F.col("id") == F.col("i")).select(*FEATURES, "label"), "training")
    good, bad = data.agg(F.sum(F.col("label")), F.sum(1 - F.col("label"))).first()
    if not good or not bad:
        return [0.0] * len(FEATURES), 0.0
    model = LogisticRegression(regParam=0.001, maxIter=60).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data))
    return [float(c) for c in model.coefficients], float(model.intercept)


def log_odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def strength(groups: DataFrame, centre: Column) -> float:
    """Prior strength from the spread of group shares: k = m (1 - m) / V - 1, within 1 and 1e6.
    V is the weighted variance of the shares around ``centre`` less what sampling alone gives."""
    share = F.col("s") / F.col("n")
    spread, noise, var, n = groups.agg(F.sum(F.col("n") * (share - centre) ** 2), F.sum(share * (1 - share)), F.sum(F.col("n") * centre * (1 - centre)), F.sum("n")).first()
    if not n or not var:
        return 1.0
    between = max(spread / n - noise / n, 1e-9)
    return min(max(var / n / between - 1, 1.0), 1e6)


class Sites:
    """Fitted model: document coefficients and the table of sites (host, path, sums, posteriors)."""

    def __init__(self, coefficients, intercept, table, share, k_host, k_path):
        self.coefficients, self.intercept, self.table = coefficients, intercept, table
        self.share, self.k_host, self.k_path = share, k_host, k_path


def document_log_odds(coefficients, intercept, get) -> Column:
    out = F.lit(intercept)
    for name, c in zip(FEATURES, coefficients):
        out = out + F.lit(c) * get(name)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", host: str = "source", path: str = "lang", text: str = "text",
        label: str = "quality", max_labelled: int = 50_000, seed: int = 3) -> tuple[Sites, DataFrame]:
    """The fitted sites and a table of rows: id, host, path, z (the document's log-odds)."""
    rows = written(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{host}`").alias("host"), F.col(f"`{path}`").alias("path"),
                               features(F.col(f"`{text}`")).alias("f")).select("id", "host", "path", "f.*"), "features")
    coefficients, intercept = fit_document_model(rows, labels, id_col, label, max_labelled, seed)
    scored = rows.select("id", "host", "path", document_log_odds(coefficients, intercept, F.col).alias("z"))
    p = 1 / (1 + F.exp(-F.col("z")))
    paths = written(scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("s")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    share = min(max((s or 0.0) / n, 1e-6), 1 - 1e-6) if n else 0.5
    k_host = strength(hosts, F.lit(share))
    both = paths.join(hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s")), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_path = strength(both, (F.col("host_s") + k_host * share) / (F.col("host_n") + k_host))
    return Sites(coefficients, intercept, written(both, "sites"), share, k_host, k_path), scored


def posteriors(sites: Sites, z: Column, site_weight: float) -> list[Column]:
    """doc_score, host_posterior, path_posterior and score of a row joined to its site."""
    p = 1 / (1 + F.exp(-z))
    host = (F.col("host_s") - p + sites.k_host * sites.share) / (F.col("host_n") - 1 + sites.k_host)
    of_path = (F.col("s") - p + sites.k_path * host) / (F.col("n") - 1 + sites.k_path)
    final = z + site_weight * (log_odds(of_path) - math.log(sites.share / (1 - sites.share)))
    return [p.alias("doc_score"), host.alias("host_posterior"), of_path.alias("path_posterior"), (1 / (1 + F.exp(-final))).alias("score")]


def joined_sites(df: DataFrame, sites: Sites, host: Column, path: Column) -> DataFrame:
    t = sites.table.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "s", "host_n", "host_s")
    return df.join(t, host.eqNullSafe(F.col("_h")) & path.eqNullSafe(F.col("_p")))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", site_weight: float = 0.5, threshold: float = 0.5, **options) -> DataFrame:
    """Per row: id, doc_score, host_posterior, path_posterior, score, kept."""
    sites, scored = fit(docs, labels, id_col, **options)
    rows = joined_sites(scored, sites, F.col("host"), F.col("path"))
    return rows.select(F.col("id").alias(id_col), *posteriors(sites, F.col("z"), site_weight)).withColumn("kept", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", host: str = "source", path: str = "lang", text: str = "text",
              site_weight: float = 0.5, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns; texts are not shuffled."""
    sites, _ = fit(docs, labels, id_col, host, path, text, **options)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), features(F.col(f"`{text}`")).alias("f"))
    z = document_log_odds(sites.coefficients, sites.intercept, lambda name: F.col(f"f.{name}"))
    # z is never null; said so, no null check of it is pushed below, where it would compute the features again
    rows = joined_sites(whole.select("row", F.coalesce(z, F.lit(0.0)).alias("z")), sites, F.col(f"row.`{host}`"), F.col(f"row.`{path}`"))
    return rows.filter(posteriors(sites, F.col("z"), site_weight)[3] >= threshold).select("row.*")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
