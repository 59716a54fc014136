"""Community text: cleaning, ordered per-(channel, day) documents, greedy
wrapping into chunks, extractive TF-IDF summaries, sentiment from a lexicon
learned on labelled documents or from a trained classifier, and a summary of
the negative messages.

Re-aimed from hosted models: the summariser is extractive (sentences ranked by mean
TF-IDF of their words, top-n per document, then top-n per group), sentiment is
learned from the ``labels`` table.  Every text is processed whole."""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.functions.exprs import clean_message
from ledgerline.operators.aggregates import join_text
from ledgerline.session import cut_lineage

SENTENCE_SPLIT = r"[.!?]+"
WORD_SPLIT = r"[^\p{L}]+"


def clean(df: DataFrame, col: str = "content", out: str = "clean_content") -> DataFrame:
    """Clean every message (NULL text stays NULL and is skipped downstream)."""
    return df.withColumn(out, clean_message(col))


def daily_documents(df: DataFrame, keys: Sequence[str] = ("channel",), ts: str = "ts",
                    order: Sequence[str] = ("ts", "conv_id", "turn"), text: str = "clean_content") -> DataFrame:
    """One newline-joined document per (channel, day), messages in time order."""
    d = df.withColumn("day", F.to_date(ts))
    return join_text(d, [*keys, "day"], [o for o in order if o in d.columns], text, sep="\n", out="text")


# Fixed patterns of word wrapping: a piece is a run of spaces, a dash of two or more between words, or a word, which
# may end after a hyphen between letters.  White space that ends a line is dropped.
WRAP_PIECE = (r"(?U)[ ]+|(?<=[\w!\"'&.,?])-{2,}(?=\w)|[^ ]+?(?:-(?:(?<=[\w&&[^\d]]{2}-)|(?<=[\w&&[^\d]]-[\w&&[^\d]]-))"
              r"(?=[\w&&[^\d]]-?[\w&&[^\d]])|(?=[ ]|\z)|(?<=[\w!\"'&.,?])(?=-{2,}\w))")
BLANK = r"^[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]*$"
# The same for whole lines: a run of white space other than spaces, and the places where a piece ends (the last one needs
# the width, which bounds a run of dashes).
BLANK_RUN = BLANK[1:-2].replace("\\x20", "\\x1F") + "+"
PIECE_END = (r"\z|(?<=[^ ])(?=[ ])|(?<=[ ])(?=[^ ])|(?<=-)(?:(?<=[\w&&[^\d]]{2}-)|(?<=[\w&&[^\d]]-[\w&&[^\d]]-))(?=[\w&&[^\d]]-?[\w&&[^\d]])"
             r"|(?<=[\w!\"'&.,?])(?=-{2,}\w)|(?<=--)(?=\w)(?<=[\w!\"'&.,?]-{2,%d})")


def expand_tabs(c: Column, size: int = 8) -> Column:
    """Tabs to spaces up to the next stop of each line, then every white space character to a space."""
    def line(x):
        parts = F.split(x, "\t", -1)
        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), parts[0], lambda acc, p: F.concat(F.rpad(acc, (F.floor(F.length(acc) / size) * size + size).cast("int"), " "), p))

    wide = F.when(F.contains(c, F.lit("\t")), F.array_join(F.transform(F.split(c, "[\n\r]", -1), line), " ")).otherwise(c)
    return F.translate(wide, "\t\n\x0b\x0c\r", "     ")


def wrapped(text: Column, width: int) -> Column:
    """The lines of greedily wrapped text: as many pieces as fit into ``width`` characters; a piece longer than a line
    is cut, after its last hyphen that still fits if it has one.

    Lines are matched whole, each up to the last end of a piece within the width, which takes one pass over a text.  Only texts that
    may hold a piece longer than a line, or begin with a line of blanks, are folded piece by piece."""
    line = (rf"(?Us)(?:(?!\A)(?:[ ]+|{BLANK_RUN}(?=[ ]|\z)))?+(.{{1,{width}}})(?:{PIECE_END % max(width, 2)})")
    long_run = rf"(?<![^ ])[^ ]{{{width + 1}}}|(?<![ ])[ ]{{{width + 1}}}"

    def trimmed(x):
        """A line without its last piece if that is blank."""
        return F.when(x.endswith(" "), F.rtrim(x)).otherwise(F.regexp_replace(x, rf"(?<![^ ]){BLANK_RUN}\z", ""))

    def lines(t):
        found = F.regexp_extract_all(t, F.lit(line), F.lit(1))
        return F.transform(F.array(found), lambda v: F.when(F.get(v, F.lit(0)).rlike(BLANK), folded(t, width))
                           .otherwise(F.filter(F.transform(v, trimmed), lambda x: x != "")))[0]

    return F.transform(F.array(expand_tabs(text)), lambda t: F.when(t.rlike(long_run), folded(t, width)).otherwise(lines(t)))[0]


def folded(text: Column, width: int) -> Column:
    """The lines of a text without tabs or line ends, by one fold over its pieces."""
    pieces = F.regexp_extract_all(text, F.lit(WRAP_PIECE), F.lit(0))
    none, zero = F.lit(""), F.lit(0)
    blank = lambda p: p.rlike(BLANK)

    def state(done, cur=none, n=zero, tail=zero, rest=none, skipped=F.lit(False)):
        return F.struct(done.alias("done"), cur.alias("cur"), n.alias("n"), tail.alias("tail"), rest.alias("rest"), skipped.alias("skipped"))

    def skips(s, p):
        """A later line drops the blank piece it would begin with, but no second one."""
        return (s["n"] == 0) & ~s["skipped"] & (F.size(s["done"]) > 0) & blank(p)


    def closed(s):
        """The lines with the current one ended; ``tail`` is the length of a blank last piece."""
        line = F.substring(s["cur"], F.lit(1), s["n"] - s["tail"])
        return F.when(s["n"] > s["tail"], F.concat(s["done"], F.array(line))).otherwise(s["done"])

    def put(s, p):
        """Piece ``p`` taken into the current line."""
        return F.when(skips(s, p), state(s["done"], skipped=F.lit(True))).otherwise(
            state(s["done"], F.concat(s["cur"], p), s["n"] + F.length(p), F.when(blank(p), F.length(p)).otherwise(zero), skipped=s["skipped"]))

    def cut(s):
        """A piece longer than a line: what fits now, the line ended, the rest kept."""
        free = F.lit(width) - s["n"]
        front = F.substring(s["rest"], zero + 1, free)
        hyphen = free - F.instr(F.reverse(front), "-") + 1                 # place of the last hyphen that fits
        after = F.when(F.contains(front, F.lit("-")) & (hyphen > 1) & F.substring(front, zero + 1, hyphen - 1).rlike("[^-]"), hyphen).otherwise(free)
        return F.transform(F.array(after), lambda k: F.transform(F.array(F.substring(s["rest"], zero + 1, k)), lambda f: state(
            closed(state(s["done"], F.concat(s["cur"], f), s["n"] + F.length(f), F.when(blank(f), F.length(f)).otherwise(zero))),
            rest=F.substring(s["rest"], k + 1, F.length(s["rest"]))))[0])[0]

    def long_piece(s, p):
        def again(x, _):
            return (F.when(F.length(x["rest"]) == 0, x).when(skips(x, x["rest"]), state(x["done"], skipped=F.lit(True)))
                    .when(x["n"] + F.length(x["rest"]) <= width, put(x, x["rest"])).when(F.length(x["rest"]) > width, cut(x))
                    .otherwise(put(state(closed(x)), x["rest"])))

        return F.aggregate(F.sequence(zero, F.length(p)), state(s["done"], s["cur"], s["n"], s["tail"], p, s["skipped"]), again)

    def step(s, p):
        return (F.when(s["n"] + F.length(p) <= width, put(s, p)).when(F.length(p) > width, long_piece(s, p))
                .otherwise(put(state(closed(s)), p)))

    return F.aggregate(pieces, state(F.array().cast("array<string>")), step, closed)


def wrap(df: DataFrame, text: str = "text", width: int = 3000) -> DataFrame:
    """Greedy word wrap of each whole document into chunks of at most ``width``
    characters (long words are cut, hyphenated words may break) — one row per chunk."""
    return df.select("*", F.posexplode(wrapped(F.col(text), width)).alias("chunk_no", "chunk")).drop(text)


def sentences(df: DataFrame, doc_keys: Sequence[str], text: str) -> DataFrame:
    s = df.select(
        *doc_keys, F.posexplode(F.split(F.col(text), SENTENCE_SPLIT)).alias("pos", "sent"))
    return s.withColumn("sent", F.trim(F.col("sent"))).filter(F.col("sent") != "")


COMMON = 50_000        # words whose frequencies are broadcast


def word_frequencies(df: DataFrame, sents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(w, ldf): ln of the number of sentences that hold the word.  A sentence is one row of ``sents``, so words are
    counted map-side; only where documents share their key are their sentences (key, pos) merged, and what they were counted too
    often is taken off again."""
    raw = sents.select(F.explode(F.array_distinct("ws")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    shared = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    some = shared.agg(F.count(F.lit(1)).alias("n")).scalar()              # none: no text is shuffled for them
    merged = sents.filter(some > 0).join(shared, same, "left_semi").select(*keys, "pos", F.explode(F.array_distinct("ws")).alias("w"))
    extra = merged.groupBy(*keys, "pos", "w").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("w", (1 - F.col("c")).alias("n"))
    return raw.unionByName(extra).groupBy("w").agg(F.ln(F.sum("n")).alias("ldf"))


def sentence_scores(df: DataFrame, sents: DataFrame, doc_keys: Sequence[str]) -> DataFrame:
    """Sentence rarity = mean ln(document frequency) of its words, where a word's
    document frequency counts the sentences containing it.  Mean TF-IDF is
    ln(N) minus this, so ranking by rarity ascending is ranking by mean TF-IDF
    descending, without a separate pass to count N.  The ``COMMON`` most frequent words meet their frequency in a
    broadcast of that many rows, where a sentence's words are summed up in place; only the occurrences of the others are shuffled."""
    skey = [*doc_keys, "pos"]
    listed = sents.select(*skey, F.filter(F.split(F.lower(F.col("sent")), WORD_SPLIT), lambda w: w != "").alias("ws"))
    ldf = word_frequencies(df, listed, doc_keys)
    common = F.broadcast(ldf.orderBy(F.col("ldf").desc(), "w").limit(COMMON))
    words = listed.select(*skey, F.explode("ws").alias("w"))
    known = words.join(common, "w").select(*skey, "ldf")
    rare = words.join(common, "w", "left_anti").join(ldf, "w").select(*skey, "ldf")
    sc = known.unionByName(rare).groupBy(*skey).agg((F.sum("ldf") / F.count(F.lit(1))).alias("rarity"))
    return sc.withColumn("rarity", F.round("rarity", 9))


def summarise(df: DataFrame, group: Sequence[str], doc_key: Sequence[str], text: str, n1: int = 3, n2: int = 5) -> DataFrame:
    """Two-level extractive summary: top ``n1`` sentences per document, then the top
    ``n2`` of those per group, re-joined in document order.  Ranking runs on
    (keys, score) only; the text of the <= n2 winners per group is joined back,
    so no group's text is gathered whole.  ``df`` is read several times."""
    keys = [*group, *doc_key]
    sc = sentence_scores(df, sentences(df, keys, text), keys)
    w1 = Window.partitionBy(*keys).orderBy(F.col("rarity").asc(), "pos")
    top1 = sc.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= n1)
    w2 = Window.partitionBy(*group).orderBy(F.col("rarity").asc(), *doc_key, "pos")
    top2 = top1.withColumn("_r2", F.row_number().over(w2)).filter(F.col("_r2") <= n2).select(*keys, "pos")
    picked = df.select(*keys, F.col(text).alias("_text")).join(top2, keys).select(
        *keys, "pos", F.trim(F.get(F.split("_text", SENTENCE_SPLIT), F.col("pos"))).alias("sent")).filter(F.col("sent") != "")
    ordered = F.sort_array(F.collect_list(F.struct(*[F.col(k) for k in doc_key], F.col("pos"), F.col("sent"))))
    return picked.groupBy(*group).agg(F.array_join(F.transform(ordered, lambda s: s["sent"]), " ").alias("summary"),
                                      F.count(F.lit(1)).alias("n_sentences"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", weight: float = 5.0) -> DataFrame:
    """Word polarity = log-odds of the label among labelled documents containing the
    word, minus the overall log-odds (> 0: leans to the label).  Every word counts; its
    share is smoothed towards the overall share with ``weight`` documents, so rare words
    stay near 0."""
    lab = docs.join(labels.select("doc_id", label_col), "doc_id")
    words = lab.select("doc_id", label_col, F.explode(F.split(F.lower("text"), WORD_SPLIT)).alias("w")) \
               .filter(F.col("w") != "").distinct()
    g = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum(label_col).alias("k"))
    overall = lab.agg(((F.sum(label_col) + 1) / (F.count(F.lit(1)) + 2)).alias("r")).scalar()   # one subquery run
    g = g.withColumn("r", overall)
    p = (F.col("k") + weight * F.col("r")) / (F.col("n") + weight)
    return g.select("w", F.round(F.ln(p / (1 - p)) - F.ln(F.col("r") / (1 - F.col("r"))), 9).alias("polarity"))


def sentiment_lexicon(df: DataFrame, lexicon: DataFrame, keys: Sequence[str], text: str = "clean_content") -> DataFrame:
    """Sum of word polarities per message; > 0 (label-leaning) -> NEGATIVE."""
    toks = df.select(*keys, F.explode(F.split(F.lower(F.col(text)), WORD_SPLIT)).alias("w")).filter(F.col("w") != "") \
             .groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("tf"))     # combined before the join on the word
    sc = toks.join(lexicon, "w").groupBy(*keys).agg(F.sum(F.col("tf") * F.col("polarity")).alias("score"))
    out = df.select(*keys).join(sc, list(keys), "left").fillna(0.0, subset=["score"])
    return out.withColumn("sentiment", F.when(F.col("score") > 0, "NEGATIVE").otherwise("POSITIVE"))


def train_sentiment(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", features: int = 1 << 18):
    """Tokenizer -> HashingTF -> IDF -> LogisticRegression on labelled documents."""
    train = docs.join(labels.select("doc_id", F.col(label_col).cast("double").alias("label")), "doc_id")
    pipe = Pipeline(stages=[RegexTokenizer(inputCol="text", outputCol="tok", pattern=WORD_SPLIT, toLowercase=True),
                            HashingTF(inputCol="tok", outputCol="tf", numFeatures=features),
                            IDF(inputCol="tf", outputCol="features"),
                            LogisticRegression(featuresCol="features", labelCol="label", maxIter=50, regParam=0.01)])
    return pipe.fit(train)


def sentiment_model(df: DataFrame, model, text: str = "clean_content") -> DataFrame:
    scored = model.transform(df.withColumn("text", F.coalesce(F.col(text), F.lit(""))))
    return scored.withColumn("sentiment", F.when(F.col("prediction") == 1.0, "NEGATIVE").otherwise("POSITIVE")) \
                 .drop("tok", "tf", "features", "rawPrediction", "probability")


def within_budget(df: DataFrame, group: Sequence[str], order: Sequence[str], text: str, budget: int) -> DataFrame:
    """The messages with words of each group, in order, whose words up to and with them come to at most ``budget``; a
    message is kept or dropped whole.  Every key and message left has a word, so only the first ``budget`` + 1 of a group can
    matter: they are ranked under that bound, first the keys ``order[0]`` by their sums, then the messages of those
    left."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))
    sized = df.withColumn("_w", words.cast("bigint")).filter("_w > 0")

    def first(d, parts, by, size):
        """The first rows of each part, with the words before them."""
        w = Window.partitionBy(*parts).orderBy(*by)
        top = d.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= budget + 1)
        return top.withColumn("_before", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(size)).drop("_i")

    head = order[0]
    heads = first(sized.groupBy(*group, head).agg(F.sum("_w").alias("_s")), group, [head], "_s").filter(F.col("_before") < budget)
    near = sized.join(heads.select(*group, head, F.col("_before").alias("_ahead")), [*group, head])
    kept = first(near, [*group, head], list(order[1:]) or [text], "_w")
    return kept.filter(F.col("_ahead") + F.col("_before") + F.col("_w") <= budget).drop("_w", "_before", "_ahead")


def negative_theme(messages: DataFrame, sentiment: DataFrame, keys: Sequence[str], group: Sequence[str] = ("channel",),
                   text: str = "clean_content", n1: int = 3, n2: int = 5, budget: int | None = None) -> DataFrame:
    """Summary of the negative messages per channel: every negative message whole, or with ``budget`` those that come
    first in the order of ``keys`` and hold at most so many words together."""
    neg = messages.join(sentiment.filter(F.col("sentiment") == "NEGATIVE").select(*keys), list(keys))
    order = [k for k in keys if k not in group]
    if budget is not None:
        neg = within_budget(neg, list(group), order, text, budget)
    # the summary reads its messages several times: they are written to the checkpoint folder once
    return summarise(cut_lineage(neg.select(*group, *order, text)), list(group), order, text, n1, n2)
