"""Registered community-text queries (Spark) and their DuckDB oracles."""

from __future__ import annotations

from ledgerline.plans import bindings as B
from ledgerline.plans import text as X
from ledgerline.plans.chunking import chunk_threads
from ledgerline.plans.registry import register
from ledgerline.sources.tables import read_table, recent_messages

AS_OF = "2024-01-03 00:00:00"
MSG_KEYS = ["conv_id", "turn"]

# Java's Unicode White_Space class, spelt out for RE2 (whose \s is ASCII only).
WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NWS = "[^" + WS[1:]


def clean_sql(c: str) -> str:
    s = f"regexp_replace({c}, '<@!?[0-9]+>', '', 'g')"
    s = f"regexp_replace({s}, 'http{NWS}+|www\\.{NWS}+', '', 'g')"
    s = f"regexp_replace({s}, '[*_~`]', '', 'g')"
    s = f"regexp_replace({s}, '<:[a-zA-Z0-9_]+:[0-9]+>', '', 'g')"
    s = f"regexp_replace({s}, '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')"
    s = f"regexp_replace({s}, '{WS}+', ' ', 'g')"
    return f"regexp_replace({s}, '^{WS}+|{WS}+$', '', 'g')"


def messages(spark, d):
    return X.clean(B.binding(spark, d, "messages"))


def documents(spark, d):
    return read_table(spark, "documents", d)


MSG = f"SELECT conv_id, turn, channel, ts, {clean_sql('content')} AS clean_content FROM messages"


def summ_sql(src: str, group: list[str], doc: list[str], text: str, n1: int = 3, n2: int = 5) -> str:
    keys = group + doc
    k = ", ".join(keys)
    arr = f"regexp_split_to_array({text}, '[.!?]+')"
    return f"""WITH s0 AS (SELECT {k}, unnest({arr}) AS sent, generate_subscripts({arr}, 1) - 1 AS pos FROM ({src}) AS src),
  sents AS (SELECT {k}, pos, trim(sent) AS sent FROM s0 WHERE trim(sent) != ''),
  words AS (SELECT * FROM (SELECT {k}, pos, unnest(regexp_split_to_array(lower(sent), '[^\\p{{L}}]+')) AS w FROM sents) AS x WHERE w != ''),
  ldf AS (SELECT w, ln(count(*)) AS ldf FROM (SELECT DISTINCT {k}, pos, w FROM words) AS u GROUP BY w),
  sc AS (SELECT {k}, pos, round(avg(ldf), 9) AS rarity FROM words JOIN ldf USING (w) GROUP BY {k}, pos),
  scored AS (SELECT s.*, sc.rarity FROM sents s JOIN sc USING ({k}, pos)),
  t1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY rarity, pos) AS r FROM scored) AS a WHERE r <= {n1}),
  t2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(group)} ORDER BY rarity, {', '.join(doc)}, pos) AS r2 FROM t1) AS b
         WHERE r2 <= {n2})
SELECT {', '.join(group)}, string_agg(sent, ' ' ORDER BY {', '.join(doc)}, pos) AS summary, count(*) AS n_sentences FROM t2 GROUP BY {', '.join(group)}"""


LEX = """SELECT w, round(ln(p / (1 - p)) - ln(r / (1 - r)), 9) AS polarity
  FROM (SELECT w, any_value(r) AS r, (sum(toxic) + 5.0 * any_value(r)) / (count(*) + 5.0) AS p
        FROM (SELECT DISTINCT x.doc_id, l.toxic, x.w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS w FROM documents) AS x
              JOIN labels l ON x.doc_id = l.doc_id WHERE x.w != '') AS lw,
             (SELECT (sum(l.toxic) + 1) / (count(*) + 2) AS r FROM documents d JOIN labels l ON d.doc_id = l.doc_id) AS q
        GROUP BY w) AS g"""
SENT = f"""SELECT m.conv_id, m.turn, coalesce(sc.score, 0.0) AS score,
    CASE WHEN coalesce(sc.score, 0.0) > 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END AS sentiment
  FROM msg m LEFT JOIN (SELECT conv_id, turn, sum(polarity) AS score FROM
      (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(clean_content), '[^\\p{{L}}]+')) AS w FROM msg) AS t
      JOIN lex ON t.w = lex.w WHERE t.w != '' GROUP BY 1, 2) AS sc ON m.conv_id = sc.conv_id AND m.turn = sc.turn"""


def ow(extra=None):
    return B.oracle_with(["messages"], extra)


@register("txt_clean", sql=ow({"msg": MSG}) + "SELECT conv_id, turn, clean_content FROM msg", dates=())
def q_clean(spark, d):
    """Mentions, URLs, markdown marks, custom emoji, astral characters, whitespace — in that order."""
    return messages(spark, d).select("conv_id", "turn", "clean_content")


@register("fn_clean_message", sql=f"SELECT doc_id, {clean_sql('text')} AS clean_text FROM documents", dates=())
def q_clean_docs(spark, d):
    """The message cleaner over every whole document."""
    from ledgerline.functions.exprs import clean_message
    return documents(spark, d).select("doc_id", clean_message("text").alias("clean_text"))


@register("ingest_recent_messages", sql=ow() + f"""SELECT conv_id, turn, ts, channel, author, content FROM messages
    WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{AS_OF}'""", dates=())
def q_recent(spark, d):
    """The 24 hours up to ``as_of``, newest first."""
    m = B.binding(spark, d, "messages")
    return recent_messages(m, AS_OF, 24).select("conv_id", "turn", "ts", "channel", "author", "content")


@register("agg_text_join", sql=ow({"msg": MSG}) + """SELECT channel, CAST(ts AS DATE) AS day,
    string_agg(clean_content, chr(10) ORDER BY ts, conv_id, turn) AS text FROM msg WHERE clean_content IS NOT NULL GROUP BY 1, 2""")
def q_text_join(spark, d):
    """Ordered newline concatenation per (channel, day)."""
    return X.daily_documents(messages(spark, d))


@register("txt_chunks")
def q_chunks(spark, d):
    """Per (channel, day): messages in order, wrapped to chunks of at most 3,000 characters; no channel-day is gathered."""
    return chunk_threads(messages(spark, d))


@register("fn_wrap_chunks")
def q_wrap_docs(spark, d):
    """Every whole document wrapped into chunks of at most 3,000 characters."""
    return X.wrap(documents(spark, d).select("doc_id", "text"))


@register("txt_summarise", sql=summ_sql("SELECT doc_id, source, text FROM documents", ["source"], ["doc_id"], "text"),
          dbl=[], dates=())
def q_summarise(spark, d):
    """Extractive two-level summary: top 3 sentences per document, top 5 per source."""
    return X.summarise(documents(spark, d), ["source"], ["doc_id"], "text", 3, 5)


@register("txt_sentiment_lexicon", sql=ow({"msg": MSG, "lex": LEX}) + SENT, dbl=["score"], dates=())
def q_lexicon(spark, d):
    """Messages scored with word polarities learned from labelled documents."""
    lex = X.learn_lexicon(documents(spark, d), read_table(spark, "labels", d))
    return X.sentiment_lexicon(messages(spark, d), lex, MSG_KEYS)


@register("txt_lexicon", sql=f"WITH lex AS ({LEX}) SELECT * FROM lex", dbl=["polarity"], dates=())
def q_learn_lexicon(spark, d):
    """Word polarity = smoothed log-odds of the toxic label among documents containing it."""
    return X.learn_lexicon(documents(spark, d), read_table(spark, "labels", d))


@register("txt_sentiment_model")
def q_model(spark, d):
    """Tokenizer -> HashingTF -> IDF -> LogisticRegression trained on labels, applied to messages."""
    model = X.train_sentiment(documents(spark, d), read_table(spark, "labels", d))
    return X.sentiment_model(messages(spark, d), model).select("conv_id", "turn", "sentiment")


NEG_SRC = "SELECT msg.channel, msg.conv_id, msg.turn, msg.clean_content FROM msg JOIN sent ON msg.conv_id = sent.conv_id AND msg.turn = sent.turn WHERE sent.sentiment = 'NEGATIVE'"


@register("txt_negative_theme",
          sql=ow({"msg": MSG, "lex": LEX, "sent": SENT}).rstrip("\n") + ",\n"
          + summ_sql(NEG_SRC, ["channel"], ["conv_id", "turn"], "clean_content")[5:], dates=())
def q_negative(spark, d):
    """Extractive summary of the negative messages per channel (all of them, whole)."""
    m = messages(spark, d)
    lex = X.learn_lexicon(documents(spark, d), read_table(spark, "labels", d))
    s = X.sentiment_lexicon(m, lex, MSG_KEYS)
    return X.negative_theme(m, s, MSG_KEYS, ["channel"])


NEG_BUDGET = 1024
BUDGET_SRC = f"""SELECT * FROM (SELECT n.*, sum(len(list_filter(string_split_regex(clean_content, '\\s+'), lambda x: x != '')))
    OVER (PARTITION BY channel ORDER BY conv_id, turn) AS upto FROM ({NEG_SRC}) AS n) AS b WHERE upto <= {NEG_BUDGET}"""


@register("txt_negative_budget",
          sql=ow({"msg": MSG, "lex": LEX, "sent": SENT}).rstrip("\n") + ",\n"
          + summ_sql(BUDGET_SRC, ["channel"], ["conv_id", "turn"], "clean_content")[5:], dates=())
def q_negative_budget(spark, d):
    """Summary per channel of the first negative messages that hold 1,024 words together (the feature's own limit)."""
    m = messages(spark, d)
    s = X.sentiment_lexicon(m, X.learn_lexicon(documents(spark, d), read_table(spark, "labels", d)), MSG_KEYS)
    return X.negative_theme(m, s, MSG_KEYS, ["channel"], budget=NEG_BUDGET)
