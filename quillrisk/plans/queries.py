"""Registered queries over the given tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrisk.functions import text as X
from quillrisk.operators import dedupe, evaluation, features, impact, linking, market, portfolio
from quillrisk.plans import models as M
from quillrisk.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


KEY_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '(?:https?://|www\.)\S+', ' ', 'g'), '@\w+', ' ', 'g'), '^\s*rt\b', ' '), '[^0-9a-z$%]', ' ', 'g'), ' +', ' ', 'g'))"""
PHRASE_SQL = r"""(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_]+', ' ', 'g')) || ' ')"""
FEED = f"feed AS (SELECT doc_id, text, lang, source, {M.START} + doc_id * {M.QUARTER} AS t, sha1({KEY_SQL}) AS key FROM documents)"
POSITIVE, NEGATIVE = ["for", "to", "it"], ["of", "that", "was"]
CLASSES = {"A": ["and", "to"], "B": ["in", "it"], "C": ["be", "as"]}
TOKENS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"
HITS = lambda words: f"len(list_filter({TOKENS_SQL}, lambda w: w IN ({', '.join(repr(w) for w in words)})))"


# --- sources and sinks ---
@query(r"SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '') AS outlet FROM pages")
def a2_page_outlet(spark, d):
    return table(spark, d, "pages").select("page_id", X.url_host(F.col("url")).alias("outlet"))


@query()
def a2_extract_title(spark, d):
    return table(spark, d, "pages").select("page_id", X.page_title(F.col("html")).alias("title")).where("title IS NOT NULL")


@query("""SELECT event_id FROM events WHERE minute(ts) % 15 < 5 AND CASE WHEN isodow(ts) >= 6 THEN hour(ts) IN (12, 18) ELSE hour(ts) IN (9, 12, 15, 21) END""")
def a4_schedule_filter(spark, d):
    weekend = F.dayofweek("ts").isin(1, 7)
    hours = F.when(weekend, F.hour("ts").isin(12, 18)).otherwise(F.hour("ts").isin(9, 12, 15, 21))
    return table(spark, d, "events").where((F.minute("ts") % 15 < 5) & hours).select("event_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a5_pending_inputs(spark, d):
    return M.documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("WITH " + M.PRICES + " SELECT session, " + ", ".join(f"max(CASE WHEN symbol = '{k}' THEN close END) AS {v}" for k, v in M.SYMBOLS.items()) + " FROM prices GROUP BY session")
def a12_prices_wide(spark, d):
    wide = M.prices(spark, d).groupBy("session").pivot("symbol", list(M.SYMBOLS)).agg(F.first("close"))
    return wide.toDF("session", *M.SYMBOLS.values())


@query("WITH " + M.PRICES + " SELECT DISTINCT session FROM prices WHERE symbol = '1-URGENT' AND close IS NOT NULL")
def a13_trading_days(spark, d):
    return M.prices(spark, d).where("symbol = '1-URGENT' AND close IS NOT NULL").select("session").distinct()


@query("SELECT page_id, sha1('web|' || coalesce(nullif(url, ''), html)) AS id FROM pages")
def a14_build_document(spark, d):
    return table(spark, d, "pages").select("page_id", X.document_id(F.lit("web"), F.col("url"), F.col("html")).alias("id"))


_ENDS = "(SELECT min(t) // 86400000000 + 1 AS first, max(t) // 86400000000 AS last FROM feed)"


@query(f"WITH {FEED} SELECT doc_id, t FROM feed, {_ENDS} WHERE t >= first * 86400000000 AND t < last * 86400000000")
def a16_read_feed(spark, d):
    """All but the feed's first and last day."""
    rows, day = M.feed(spark, d).select("doc_id", "t"), 86_400_000_000
    first, last = rows.agg(F.floor(F.min("t") / day) + 1, F.floor(F.max("t") / day)).first()  # one row
    return features.time_window(rows, "t", (first or 0) * day, (last or 0) * day)


@query("WITH " + M.SCORED + " SELECT seq, t, ticker, severity FROM scored WHERE ticker = 'error' AND severity >= 3 ORDER BY t DESC, seq DESC LIMIT 100")
def a18_query_signals(spark, d):
    rows = M.scored(spark, d).where("ticker = 'error' AND severity >= 3").orderBy(F.desc("t"), F.desc("seq")).limit(100)
    return rows.select("seq", "t", "ticker", "severity")


@query("""SELECT CAST(sum(CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, count(*) AS n, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders""")
def a24_table_range(spark, d):
    o = table(spark, d, "orders")
    return o.agg(F.count_if(F.col("o_totalprice").isNull()).alias("nulls"), F.count("*").alias("n"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"))


@query()  # distinct values are counted by sketch
def a24_profile_table(spark, d):
    return evaluation.profile(table(spark, d, "orders"))


# --- text ---
@query()
def b1_clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_text(F.col("html")).alias("clean"))


@query(f"SELECT doc_id, sha1({KEY_SQL}) AS key FROM documents")
def b2_dedupe_key(spark, d):
    return M.documents(spark, d).select("doc_id", X.dedupe_key(F.col("text")).alias("key"))


@query(f"SELECT doc_id, md5({PHRASE_SQL}) AS phrase FROM documents")
def b3_normalise_phrase(spark, d):
    return M.documents(spark, d).select("doc_id", F.md5(X.normal_phrase(F.col("text"))).alias("phrase"))


@query()
def b4_phrase_match(spark, d):
    return M.documents(spark, d).select("doc_id", X.phrase_count(F.col("text"), ["the", "of the", "and"]).alias("hits"))


@query(f"SELECT doc_id, contains({PHRASE_SQL}, ' of the ') OR contains({PHRASE_SQL}, 'worth') AS low FROM documents")
def b5_is_low_value(spark, d):
    return M.documents(spark, d).select("doc_id", X.contains_any(F.col("text"), [" of the ", "worth"]).alias("low"))


@query(f"""SELECT doc_id, concat_ws(',', CASE WHEN contains({PHRASE_SQL}, ' the ') OR contains({PHRASE_SQL}, 'and') THEN 'EN' END,
  CASE WHEN contains({PHRASE_SQL}, ' der ') THEN 'DE' END, CASE WHEN contains({PHRASE_SQL}, ' les ') OR contains({PHRASE_SQL}, ' et ') THEN 'FR' END) AS tags FROM documents""")
def b6_regions_of(spark, d):
    tags = X.tags_of(F.col("text"), [("EN", [" the ", "and"]), ("DE", [" der "]), ("FR", [" les ", " et "])])
    return M.documents(spark, d).select("doc_id", F.array_join(tags, ",").alias("tags"))


@query(r"SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[;.!?]+'), lambda s: trim(s, ' ')), lambda s: s <> '')) AS INTEGER) AS clauses FROM documents")
def b8_split_clauses(spark, d):
    return M.documents(spark, d).select("doc_id", F.size(X.split_clauses(F.col("text"), "[;.!?]+")).alias("clauses"))


@query(r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[a-z]+@')) <= 0")
def b9_count_pattern(spark, d):
    return M.documents(spark, d).where(F.regexp_count("text", F.lit("[a-z]+@")) <= 0).select("doc_id")


@query(f"WITH {FEED} SELECT min(doc_id) AS doc_id, text FROM feed WHERE length(text) BETWEEN 25 AND 280 GROUP BY text")
def b14_length_between(spark, d):
    return M.documents(spark, d).where(F.length("text").between(25, 280)).groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")


# --- deduplication ---
@query(f"WITH {FEED} SELECT doc_id, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, doc_id) AS n FROM feed) WHERE n = 1")
def c1_dedupe_exact(spark, d):
    rows = M.feed(spark, d).select("doc_id", "t", X.dedupe_key(F.col("text")).alias("key"))
    return dedupe.keep_first(rows, ["key"], ["t", "doc_id"]).select("doc_id", "key")


def _near(spark, d):
    # Sets of five-word shingles; a day and a language are the bucket.
    day = F.floor(F.col("t") / 86_400_000_000)
    return M.feed(spark, d).select("doc_id", "t", "lang", day.alias("day"), "text")


NEAR = f"""{FEED}, words AS (SELECT doc_id, t, lang, t // 86400000000 AS day, string_split({KEY_SQL}, ' ') AS w FROM feed),
  sets AS (SELECT doc_id, t, lang, day, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
    list_transform(range(1, CAST(greatest(2, len(w) - 3) AS BIGINT)), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS similarity
    FROM sets a JOIN sets b ON a.lang = b.lang AND a.day = b.day AND a.doc_id < b.doc_id)"""


@query(f"WITH {NEAR} SELECT a, b, similarity FROM pairs WHERE similarity >= 0.8")
def c2_near_pairs(spark, d):
    return dedupe.set_pairs(_near(spark, d), "doc_id", ["lang", "day"], X.shingles(F.col("text")))


@query()
def c2_dedupe_near(spark, d):
    rows = _near(spark, d)
    return dedupe.greedy_keep(rows.select("doc_id", "t"), "doc_id", dedupe.set_pairs(rows, "doc_id", ["lang", "day"], X.shingles(F.col("text"))), "t")


@query(f"""WITH {FEED}, flags AS (SELECT row_number() OVER (PARTITION BY key ORDER BY t, doc_id) > 1 AS e, length(text) < 100 AS s FROM feed)
  SELECT count(*) AS n_in, count_if(e) AS n_exact, count_if(NOT e AND s) AS n_near, count_if(NOT e AND NOT s) AS n_kept, 1 - count_if(NOT e AND NOT s) / count(*) AS rate FROM flags""")
def c3_dedupe_stats(spark, d):
    rows = M.feed(spark, d).withColumn("key", X.dedupe_key(F.col("text")))
    first = dedupe.keep_first(rows.select("key", "t", "doc_id"), ["key"], ["t", "doc_id"]).select("doc_id", F.lit(True).alias("first"))
    flags = rows.join(first, "doc_id", "left")
    return dedupe.dedupe_stats(flags, F.col("first").isNull(), F.length("text") < 100)


TAGS = f"tags AS (SELECT source AS label, key, CAST(contains(lower(text), 'and') AS INTEGER) AS own_tag, nullif(strpos(lower(text), substr(source, 4)), 0) AS position FROM feed)"


def _tags(spark, d):
    low = F.lower("text")
    return M.feed(spark, d).select(
        F.col("source").alias("label"), X.dedupe_key(F.col("text")).alias("key"), F.contains(low, F.lit("and")).cast("int").alias("own_tag"),
        F.nullif(F.locate("x", low) * 0 + F.expr("position(substring(source, 4) IN lower(text))"), F.lit(0)).alias("position"),
    )


@query(f"""WITH {FEED}, {TAGS}, keys AS (SELECT DISTINCT label, key FROM tags), rates AS (SELECT label, avg(own_tag) AS rate, count(DISTINCT key) AS n_keys FROM tags GROUP BY 1),
  common AS (SELECT a.label, b.label AS copy_of, count(*) AS c FROM keys a JOIN keys b ON a.key = b.key AND a.label <> b.label GROUP BY 1, 2)
  SELECT c.label, max(c.copy_of) AS copy_of, max_by(c.c / r.n_keys, c.copy_of) AS share FROM common c JOIN rates r ON c.label = r.label JOIN rates o ON o.label = c.copy_of
  WHERE r.n_keys >= 10 AND c.c / r.n_keys >= 0.05 AND r.rate < o.rate GROUP BY 1""")
def c4_copy_sets(spark, d):
    return dedupe.copy_sets(_tags(spark, d), 10, 0.05)


@query(f"""WITH {FEED}, {TAGS} SELECT key, min(struct_pack(p := coalesce(position, 1073741824), label := label)).label AS label, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM tags GROUP BY key""")
def c5_original_map(spark, d):
    tags = _tags(spark, d)
    return dedupe.original_labels(tags, tags.select("label", F.lit(None).cast("string").alias("copy_of")).where("false"))


@query(f"SELECT doc_id FROM documents WHERE {KEY_SQL} NOT IN (SELECT {KEY_SQL} FROM benchmark)")
def c8_exclude_texts(spark, d):
    return dedupe.exclude_texts(M.documents(spark, d), table(spark, d, "benchmark"), X.normal_key(F.col("text"))).select("doc_id")


# --- classes, sentiment ---
CLASS_SQL = f"""hits AS (SELECT doc_id, {HITS(['and', 'to'])} AS a, {HITS(['in', 'it'])} AS b, {HITS(['be', 'as'])} AS c FROM plain)"""
PLAIN = "plain AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z ]', ' ', 'g') AS text FROM documents)"


def _hits(spark, d):
    plain = F.regexp_replace(F.lower("text"), "[^a-z ]", " ")
    return M.documents(spark, d).select("doc_id", linking.class_hits(plain, CLASSES).alias("hits"))


@query(f"""WITH {PLAIN}, {CLASS_SQL} SELECT doc_id, CASE WHEN a + b + c = 0 THEN 'OTHER' WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'B' ELSE 'C' END AS class,
  CASE WHEN a + b + c = 0 THEN 0.0 ELSE greatest(a, b, c) / (a + b + c) END AS confidence FROM hits""")
def d4_keyword_classify(spark, d):
    label, confidence = linking.keyword_class(F.col("hits"))
    return _hits(spark, d).select("doc_id", label.alias("class"), confidence.alias("confidence"))


@query(f"""WITH {PLAIN}, {CLASS_SQL}, one AS (SELECT doc_id, CASE WHEN a > 0 THEN 'A' WHEN b > 0 THEN 'B' ELSE 'C' END AS class FROM hits WHERE (a > 0)::INT + (b > 0)::INT + (c > 0)::INT = 1)
  SELECT doc_id, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5(doc_id || ':0'), doc_id) AS n FROM one) WHERE n <= 20""")
def d5_weak_labels(spark, d):
    one = _hits(spark, d).select("doc_id", linking.single_class(F.col("hits")).alias("class")).where("class IS NOT NULL")
    return linking.sample_per_group(one, "class", "doc_id", 20)


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':0'), doc_id) AS n FROM documents) WHERE n <= 25")
def d7_sample_per_group(spark, d):
    return linking.sample_per_group(M.documents(spark, d).select("doc_id", "lang"), "lang", "doc_id", 25)


@query(f"SELECT doc_id, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0.0 END AS polarity FROM (SELECT doc_id, {HITS(POSITIVE)} AS p, {HITS(NEGATIVE)} AS n FROM documents)")
def d8_lexicon_polarity(spark, d):
    return M.documents(spark, d).select("doc_id", X.polarity(X.word_tokens(F.col("text")), POSITIVE, NEGATIVE).alias("polarity"))


@query("WITH " + M.MENTIONS + " SELECT seq, CASE WHEN sentiment > 0.15::DOUBLE THEN 'positive' WHEN sentiment < -0.15::DOUBLE THEN 'negative' ELSE 'neutral' END AS label FROM mentions")
def d9_label_from_score(spark, d):
    return M.mentions(spark, d).select("seq", X.sentiment_label(F.col("sentiment")).alias("label"))


@query(f"SELECT doc_id, x / sqrt(x * x + 15) AS valence FROM (SELECT doc_id, {HITS(['for'])} * 1.5::DOUBLE + {HITS(['it'])} * 0.5::DOUBLE - {HITS(['of'])} * 1.25::DOUBLE AS x FROM documents)")
def d19_valence(spark, d):
    return M.documents(spark, d).select("doc_id", X.valence(X.word_tokens(F.col("text")), {"for": 1.5, "it": 0.5, "of": -1.25}).alias("valence"))
