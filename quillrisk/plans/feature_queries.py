"""Registered queries: feed rules, links and classes of records, model adapters, sessions, grids and validation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrisk.functions import text as X
from quillrisk.operators import dedupe, features, linking, portfolio
from quillrisk.plans import models as M
from quillrisk.plans.entity_queries import links, links_sql
from quillrisk.plans.queries import CLASS_SQL, FEED, HITS, KEY_SQL, NEGATIVE, PHRASE_SQL, PLAIN, POSITIVE, _hits, query
from quillrisk.session import table

DAY = 86_400_000_000

# --- feed rules ---
_BASIS = f"""CASE WHEN contains(substr({PHRASE_SQL}, 1, 60), ' the ') THEN 'title' WHEN contains({PHRASE_SQL}, ' der ') THEN 'org'
  WHEN contains({PHRASE_SQL}, ' and ') AND starts_with(lang, 'e') THEN 'market' END"""


def _records(spark, d):
    phrase = X.normal_phrase(F.col("text"))
    rows = M.documents(spark, d).select("doc_id", "lang", F.explode_outer(F.array(phrase)).alias("p"))  # a filter on a plain column would work it out again at each mention
    basis = features.link_basis(F.contains(F.substring("p", 1, 60), F.lit(" the ")), F.contains("p", F.lit(" der ")), F.contains("p", F.lit(" and ")), F.startswith("lang", F.lit("e")))
    return rows.withColumn("basis", basis)


@query(f"SELECT * FROM (SELECT doc_id, {_BASIS} AS basis FROM documents) WHERE basis IS NOT NULL")
def b10_filter_records(spark, d):
    return _records(spark, d).where("basis IS NOT NULL").select("doc_id", "basis")


@query(f"SELECT doc_id, basis FROM (SELECT doc_id, CASE WHEN b = 'title' AND contains(p, ' of the ') THEN CASE WHEN contains(p, ' and ') THEN 'market' END ELSE b END AS basis FROM (SELECT doc_id, {_BASIS} AS b, {PHRASE_SQL} AS p FROM documents) WHERE b IS NOT NULL) WHERE basis IS NOT NULL")
def b11_relink(spark, d):
    low = (F.col("basis") == "title") & F.contains("p", F.lit(" of the "))
    again = F.when(low, F.when(F.contains("p", F.lit(" and ")), "market")).otherwise(F.col("basis"))
    return _records(spark, d).where("basis IS NOT NULL").withColumn("basis", again).where("basis IS NOT NULL").select("doc_id", "basis")


@query(f"SELECT CASE WHEN b IS NULL THEN 'no link' WHEN b = 'org' THEN 'org only' WHEN b = 'market' AND NOT contains(p, ' in ') THEN 'no theme' ELSE 'kept: ' || b END AS reason, count(*) AS n FROM (SELECT {_BASIS} AS b, {PHRASE_SQL} AS p FROM documents) GROUP BY 1")
def b12_feed_gates(spark, d):
    reason = features.gate_reason(F.col("basis"), F.contains("p", F.lit(" in ")))
    return _records(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {M.MENTIONS} SELECT seq, t FROM mentions WHERE t >= {M.START + 3 * DAY} AND t < {M.START + 5 * DAY}")
def b13_time_window(spark, d):
    return features.time_window(M.mentions(spark, d), "t", M.START + 3 * DAY, M.START + 5 * DAY).select("seq", "t")


_ORGS = [("en inc", "EN"), ("de inc", "DE"), ("fr inc", "FR"), ("src1", "ONE")]


@query("WITH o AS (SELECT doc_id, unnest([source, lang || ' Inc.', lang || ', inc']) AS org FROM documents), a(org, ticker) AS (VALUES " + ", ".join(map(repr, _ORGS)) + ") SELECT doc_id, ticker, count(*) * 0.5::DOUBLE AS bonus FROM (SELECT doc_id, trim(regexp_replace(lower(org), '[^a-z0-9_]+', ' ', 'g')) AS org FROM o) JOIN a USING (org) GROUP BY 1, 2")
def b15_org_match(spark, d):
    orgs = F.array(F.col("source"), F.concat("lang", F.lit(" Inc.")), F.concat("lang", F.lit(", inc")))
    aliases = spark.createDataFrame(_ORGS, "org string, ticker string")
    return features.org_match(M.documents(spark, d).select("doc_id", orgs.alias("orgs")), "doc_id", "orgs", aliases)


@query(r"""WITH v AS (SELECT e.vec_id, CAST(embedding AS DOUBLE[]) AS e, lower(trim(text)) AS key, regexp_extract(text, '^[^.\n]*') AS title FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id), r AS (SELECT * FROM v WHERE vec_id % 100 = 0),
  near AS (SELECT v.vec_id, max(list_sum(list_transform(list_zip(v.e, r.e), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform(v.e, lambda x: x * x)) * list_sum(list_transform(r.e, lambda x: x * x)))) AS most,
    coalesce(bool_or(levenshtein(v.title, r.title) <= floor(0.1::DOUBLE * greatest(length(v.title), length(r.title)) + 1e-9)), false) AS close FROM v, r GROUP BY 1)
  SELECT vec_id FROM v JOIN near USING (vec_id) WHERE vec_id % 100 <> 0 AND most < 0.3::DOUBLE AND NOT close AND (key IS NULL OR key NOT IN (SELECT key FROM r WHERE key IS NOT NULL))""")
def c7_exclude_similar(spark, d):
    """Titles are whole first sentences."""
    texts = M.documents(spark, d).select(F.col("doc_id").alias("vec_id"), F.lower(F.trim("text")).alias("key"), F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"))
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).join(texts, "vec_id", "left")
    return features.exclude_similar(rows, rows.where("vec_id % 100 = 0"), "vec_id", "e", "key", 0.3, "title").select("vec_id")


# --- links, classes, models ---
_FOUND = f"found AS ({links_sql(with_prior=False)})"


@query(f"""WITH {_FOUND}, given AS (SELECT doc_id AS id, upper(lang) AS ticker FROM documents WHERE lang IS NOT NULL),
  merged AS (SELECT id, ticker, relevance FROM found UNION ALL SELECT id, ticker, 0.3::DOUBLE FROM given g WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.id = g.id AND f.ticker = g.ticker)),
  n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM merged) SELECT id, ticker, relevance FROM n WHERE ticker <> 'MKT' OR n = 1""")
def d2_merge_labels(spark, d):
    given = M.documents(spark, d).where("lang IS NOT NULL").select(F.col("doc_id").alias("id"), F.upper("lang").alias("ticker"))
    return features.merge_labels(links(spark, d, with_prior=False), given, market="MKT")


@query(f"""WITH {_FOUND}, own AS (SELECT doc_id AS id, upper(lang) AS ticker FROM documents WHERE upper(lang) IN ('EN', 'DE', 'FR'))
  SELECT id, ticker, coalesce(f.relevance, 0.3::DOUBLE) AS relevance, f.relevance IS NULL AS relinked FROM own LEFT JOIN found f USING (id, ticker)""")
def d3_social_link_policy(spark, d):
    own = M.documents(spark, d).select(F.col("doc_id").alias("id"), F.upper("lang").alias("ticker"))
    return features.social_links(own, links(spark, d, with_prior=False), ["EN", "DE", "FR"])


@query(f"SELECT doc_id, CASE lang WHEN 'en' THEN 'A' WHEN 'fr' THEN 'C' ELSE 'B' END AS class FROM documents WHERE lang IN ('en', 'fr') OR (lang = 'de' AND contains({PHRASE_SQL}, ' der '))")
def d6_map_topic_labels(spark, d):
    topic = features.topic_class(F.col("lang"), {"en": "A", "fr": "C"}, {"de": ("B", " der ")}, X.normal_phrase(F.col("text")))
    return M.documents(spark, d).select("doc_id", topic.alias("class")).where("class IS NOT NULL")


@query(f"SELECT doc_id, CASE WHEN lang = 'en' THEN CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END ELSE (p - n) / (p + n + 2) END AS score FROM (SELECT doc_id, lang, {HITS(POSITIVE)} AS p, {HITS(NEGATIVE)} AS n FROM documents)")
def d10_score_with_model(spark, d):
    score = lambda prior: features.lexicon_model(X.word_tokens(F.col("text")), POSITIVE, NEGATIVE, prior)
    own = F.coalesce(F.col("lang") == "en", F.lit(False))
    return M.documents(spark, d).select("doc_id", F.when(own, score(0)).otherwise(score(2)).alias("score"))


_TOK = lambda words: f"len(list_filter(regexp_extract_all(lower(s), '[a-z]+'), lambda w: w IN ({', '.join(map(repr, words))})))"
_POL = lambda p, n: f"CASE WHEN {p} + {n} > 0 THEN ({p} - {n}) / ({p} + {n}) ELSE 0 END"


@query(rf"""WITH c AS (SELECT doc_id AS id, unnest(regexp_split_to_array(text, '[;.!?]+')) AS s FROM documents), k AS (SELECT id, s, {_POL(_TOK(POSITIVE), _TOK(NEGATIVE))} AS score FROM c),
  m AS (SELECT id, 'EN' AS ticker, 1.0::DOUBLE AS r, score FROM k WHERE {_TOK(['the'])} > 0 UNION ALL SELECT id, 'AN', 0.5::DOUBLE, score FROM k WHERE {_TOK(['and'])} > 0),
  e AS (SELECT id, ticker, sum(score * r) / sum(r) AS own FROM m GROUP BY 1, 2), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM e)
  SELECT n.id, ticker, CASE WHEN n >= 2 THEN own ELSE {_POL('p', 'q')} END AS sentiment FROM n JOIN (SELECT doc_id, {HITS(POSITIVE)} AS p, {HITS(NEGATIVE)} AS q FROM documents) d ON d.doc_id = n.id""")
def d11_entity_sentiment(spark, d):
    docs = M.documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    tokens = X.word_tokens(F.col("s"))
    clauses = docs.select("id", F.posexplode(F.split("text", "[;.!?]+")).alias("clause", "s")).select("id", "clause", X.polarity(tokens, POSITIVE, NEGATIVE).alias("score"), tokens.alias("w"))
    named = F.array(*[F.when(F.array_contains("w", w), F.struct(F.lit(t).alias("ticker"), F.lit(r).alias("relevance"))) for w, t, r in (("the", "EN", 1.0), ("and", "AN", 0.5))])
    mentions = clauses.select("id", "clause", F.explode(F.array_compact(named)).alias("m")).select("id", "clause", "m.ticker", "m.relevance")
    scores = docs.select("id", X.polarity(X.word_tokens(F.col("text")), POSITIVE, NEGATIVE).alias("score"))
    return linking.entity_sentiment(clauses.select("id", "clause", "score"), mentions, scores)


@query(f"WITH {PLAIN}, {CLASS_SQL}, p AS (SELECT doc_id, (a + 1) / (a + b + c + 3) AS a, (b + 1) / (a + b + c + 3) AS b, (c + 1) / (a + b + c + 3) AS c FROM hits) SELECT doc_id, CASE WHEN greatest(a, b, c) < 0.5 THEN 'OTHER' WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'B' ELSE 'C' END AS class, greatest(a, b, c) AS confidence FROM p")
def d14_predict_with_reject(spark, d):
    total = F.aggregate("hits", F.lit(3), lambda s, h: s + h["hits"])
    label, sure = linking.reject(F.transform("hits", lambda h: h["class"]), F.transform("hits", lambda h: (h["hits"] + 1) / total))
    return _hits(spark, d).select("doc_id", label.alias("class"), sure.alias("confidence"))


@query(f"WITH {PLAIN}, {CLASS_SQL} SELECT doc_id, ln(1 + a) AS a, ln(1 + b) AS b, ln(1 + c) AS c FROM hits")
def d15_keyword_features(spark, d):
    return _hits(spark, d).select("doc_id", *[F.log1p(F.col("hits")[k]["hits"].cast("double")).alias(n) for k, n in enumerate("abc")])


@query(f"WITH {PLAIN}, {CLASS_SQL} SELECT doc_id, CASE WHEN (a > 0)::INT + (b > 0)::INT + (c > 0)::INT = 1 THEN CASE WHEN a > 0 THEN 'A' WHEN b > 0 THEN 'B' ELSE 'C' END ELSE upper(lang) END AS class FROM hits JOIN documents USING (doc_id)")
def d16_rule_override(spark, d):
    rows = _hits(spark, d).select("doc_id", "hits").join(M.documents(spark, d).select("doc_id", "lang"), "doc_id")
    return rows.select("doc_id", F.coalesce(linking.single_class(F.col("hits")), F.upper("lang")).alias("class"))


@query(f"""WITH {M.SCORED}, f AS (SELECT ticker, story % 5 AS fold, avg(raw) AS score FROM scored GROUP BY 1, 2), s AS (SELECT ticker AS candidate, avg(score) AS mean, stddev_samp(score) / sqrt(count(*)) AS se FROM f GROUP BY 1),
  b AS (SELECT mean - se AS least FROM s ORDER BY mean DESC, candidate LIMIT 1) SELECT candidate, mean, se, row_number() OVER (ORDER BY mean < least, candidate) = 1 AS chosen FROM s, b""")
def d17_one_se_selection(spark, d):
    rows = M.scored(spark, d).groupBy(F.col("ticker").alias("candidate"), (F.col("story") % 5).alias("fold")).agg(F.avg("raw").alias("score"))
    return features.one_se(rows, "candidate", "score", "candidate")


@query(f"SELECT doc_id, CASE WHEN x + y = 0 THEN 'none' WHEN x >= y THEN 'and' ELSE 'the' END AS label, CASE WHEN x + y = 0 THEN 0 ELSE greatest(x, y) / (x + y) END AS score FROM (SELECT doc_id, {HITS(['and'])} AS x, {HITS(['the'])} AS y FROM documents)")
def d18_zero_shot_score(spark, d):
    label, score = features.zero_shot(X.word_tokens(F.col("text")), ["and", "the"], "none")
    return M.documents(spark, d).select("doc_id", label.alias("label"), score.alias("score"))


@query("""WITH u AS (SELECT doc_id, text, 1 AS place, CAST(toxic AS VARCHAR) AS label FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL UNION ALL SELECT doc_id, text, 2, 'OTHER' FROM documents),
  f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY place, doc_id) AS n FROM u WHERE text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL)),
  k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':0'), doc_id) AS r FROM f WHERE n = 1) SELECT doc_id, label, place = 2 AND doc_id % 5 = 0 AS held_out FROM k WHERE label <> 'OTHER' OR r <= 200""")
def d20_assemble_training_set(spark, d):
    docs = M.documents(spark, d).select("doc_id", "text")
    human = table(spark, d, "labels").where("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("string").alias("label")).join(docs, "doc_id")
    weak = docs.withColumn("label", F.lit("OTHER"))
    return features.training_set([human, weak], table(spark, d, "benchmark"), cap=200).select("doc_id", "label", ((F.col("place") == 2) & (F.col("doc_id") % 5 == 0)).alias("held_out"))


@query(f"WITH {PLAIN}, {CLASS_SQL}, o AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text) SELECT doc_id, greatest(a, b, c) / (a + b + c) AS confidence FROM hits JOIN o USING (doc_id) WHERE a + b + c > 0 AND greatest(a, b, c) / (a + b + c) >= 0.9")
def d21_confident_labels(spark, d):
    first = M.documents(spark, d).groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    _, sure = linking.keyword_class(F.col("hits"))
    return _hits(spark, d).select("doc_id", sure.alias("confidence")).where("confidence >= 0.9").join(first, "doc_id", "left_semi")


# --- signals, sessions, grids ---
@query(f"WITH {M.MENTIONS} SELECT seq, 0.8::DOUBLE * (abs(sentiment) * 0.35::DOUBLE + event_confidence * 0.25::DOUBLE + outlet / 20 * 0.15::DOUBLE + 0.15::DOUBLE + 0.05::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * relevance) AS raw FROM mentions")
def e21_recompute_from_drivers(spark, d):
    drivers = {"sentiment_strength": F.abs("sentiment"), "velocity": F.col("event_confidence"), "breadth": F.col("outlet") / 20, "novelty": F.lit(1.0), "credibility": F.lit(0.5)}
    stored = M.mentions(spark, d).select("seq", "relevance", F.to_json(F.struct(*[c.alias(n) for n, c in drivers.items()])).alias("drivers"))
    return features.recompute(stored, "drivers", list(drivers), F.lit(0.8)).select("seq", "raw")


@query(f"""WITH {M.MENTIONS}, n AS (SELECT ticker, t // {DAY} AS day, sum(CASE WHEN sentiment > 0.15::DOUBLE THEN 1 WHEN sentiment < -0.15::DOUBLE THEN -1 ELSE 0 END) AS net FROM mentions GROUP BY 1, 2),
  g AS (SELECT DISTINCT ticker, unnest(range((SELECT min(day) FROM n), (SELECT max(day) + 1 FROM n))) AS day FROM n),
  x AS (SELECT g.ticker, g.day, sum(m.sentiment * m.relevance * pow(2, (m.t - (g.day + 1) * {DAY}) / {float(DAY)})) AS num, sum(m.relevance * pow(2, (m.t - (g.day + 1) * {DAY}) / {float(DAY)})) AS den FROM g LEFT JOIN mentions m ON m.ticker = g.ticker AND m.t < (g.day + 1) * {DAY} GROUP BY 1, 2)
  SELECT x.ticker, x.day, CAST(coalesce(n.net, 0) AS BIGINT) AS net, coalesce(num / den, 0) AS level, 1 - exp(-coalesce(den, 0) / 3) AS confidence FROM x LEFT JOIN n USING (ticker, day)""")
def f2_daily_sentiment(spark, d):
    return features.daily_sentiment(M.mentions(spark, d), "ticker", "t", "sentiment", "relevance")


@query(f"WITH {M.PRICES}, f AS (SELECT session, close / first_value(close) OVER (PARTITION BY symbol ORDER BY session) AS grown FROM prices), v AS (SELECT session, avg(grown) AS value FROM f GROUP BY 1) SELECT session, value, value / lag(value) OVER (ORDER BY session) - 1 AS ret FROM v")
def f15_buy_and_hold(spark, d):
    return features.buy_and_hold(M.prices(spark, d), "symbol", "session", "close")


_KAPPAS = [0.0, 0.5, 1.0, 2.0, 4.0, 8.0]
_GRID = f"""WITH {M.MARKET}, ks AS (SELECT unnest([{', '.join(f'{k}::DOUBLE' for k in _KAPPAS)}]) AS kappa), t AS (SELECT kappa, session, symbol, ret, 0.2::DOUBLE * exp(kappa * greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ret)) * 0.5::DOUBLE) AS w FROM market, ks WHERE ret IS NOT NULL),
  w AS (SELECT *, w / sum(w) OVER (PARTITION BY kappa, session) AS weight FROM t)"""


def _kappa_grid(spark, d):
    rows = M.market(spark, d).where("ret IS NOT NULL").select("session", "symbol", "ret", F.lit(0.2).alias("base"), F.lit(0.5).alias("sure"))
    return features.tilt_grid(rows, "session", "base", "ret", "sure", _KAPPAS)


@query(_GRID + " SELECT kappa, quantile_cont(abs(weight - 0.2::DOUBLE), 0.5) AS active FROM w GROUP BY 1")
def f16_calibrate_kappa(spark, d):
    return _kappa_grid(spark, d).groupBy("kappa").agg(F.percentile(F.abs(F.col("weight") - 0.2), 0.5).alias("active"))


@query(_GRID + ", n AS (SELECT *, lead(ret) OVER (PARTITION BY kappa, symbol ORDER BY session) AS next FROM w), r AS (SELECT kappa, session, sum(weight * next) AS ret FROM n WHERE next IS NOT NULL GROUP BY 1, 2), a AS (SELECT kappa, avg(ret) AS mean FROM r GROUP BY 1) SELECT kappa, mean, mean - (SELECT mean FROM a WHERE kappa = 0) AS excess FROM a")
def f17_sensitivity_grid(spark, d):
    rows = _kappa_grid(spark, d).withColumn("next", F.lead("ret").over(Window.partitionBy("kappa", "symbol").orderBy("session"))).where("next IS NOT NULL")
    means = rows.groupBy("kappa", "session").agg(F.sum(F.col("weight") * F.col("next")).alias("ret")).groupBy("kappa").agg(F.avg("ret").alias("mean"))
    return features.excess_over(means, "kappa", 0.0, "mean")


_WHAT_IF = {"rate_3m": [0.0, 100.0], "credit": [0.0, 200.0], "equity": [-0.1, 0.1]}
_WHAT_IF_RUNS = {f"{r}/{c}/{e}": {"rate_3m": r, "credit": c, "equity": e} for r in _WHAT_IF["rate_3m"] for c in _WHAT_IF["credit"] for e in _WHAT_IF["equity"]}


@query(f"WITH {M.valued_sql(_WHAT_IF_RUNS)} SELECT run, sum(pnl) AS pnl, sum(d_el) AS d_el FROM valued GROUP BY 1")
def g11_what_if_grid(spark, d):
    grid = features.what_if(spark, _WHAT_IF, ["rate_3m", "credit", "equity"])
    rest = {"rate_10y": F.lit(0.0), "vol": F.lit(0.0), "fx": F.create_map().cast("map<string,double>"), "sectors": F.create_map().cast("map<string,double>"), "regions": F.array().cast("array<string>")}
    return portfolio.revalue(portfolio.condense(M.positions(spark, d)), grid.withColumns(rest), M.BBB_BP).groupBy("run").agg(F.sum("pnl").alias("pnl"), F.sum("d_el").alias("d_el"))


# --- validation ---
@query(f"""WITH {M.MARKET}, s AS (SELECT DISTINCT session, market FROM market WHERE market IS NOT NULL), d AS (SELECT draw, abs(market) AS m, row_number() OVER (PARTITION BY draw ORDER BY md5(session || ':' || draw), session) AS n FROM s, (SELECT unnest(range(1, 1001)) AS draw)),
  h AS (SELECT draw, avg(CAST(m >= 0.02 AS INTEGER)) AS hit FROM d WHERE n <= 25 GROUP BY 1) SELECT avg(hit) AS mean, quantile_cont(hit, 0.025) AS low, quantile_cont(hit, 0.975) AS high FROM h""")
def h11_random_baseline(spark, d):
    sessions = M.market(spark, d).where("market IS NOT NULL").select("session", (F.abs("market") >= 0.02).cast("int").alias("hit")).distinct()
    return features.random_baseline(sessions, "session", "hit", 25, 1000)


@query(f"""WITH {M.PRICES}, y AS (SELECT symbol AS factor, year(session) AS year, max_by(close, session) / min_by(close, session) - 1 AS move FROM prices GROUP BY 1, 2)
  SELECT factor, count(*) AS n, avg(CAST(sign(a.move) = sign(b.move) AS INTEGER)) AS agreed, avg(abs(a.move - b.move)) AS error FROM y a JOIN y b USING (factor) WHERE b.year = a.year + 1 GROUP BY 1""")
def h12_predicted_vs_realised(spark, d):
    moves = M.prices(spark, d).groupBy(F.col("symbol").alias("factor"), F.year("session").alias("run")).agg((F.max_by("close", "session") / F.min_by("close", "session") - 1).alias("move"))
    return features.predicted_vs_realised(moves.withColumn("run", F.col("run") + 1), moves, "factor", "run", "move")


@query(f"WITH {M.MENTIONS}, b AS (SELECT t, count(*) AS n FROM mentions GROUP BY 1) SELECT quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.95) AS p95, max(n) AS most, sum(n)::DOUBLE / count(*) AS mean FROM b")
def h14_batch_percentiles(spark, d):
    n = M.mentions(spark, d).groupBy("t").agg(F.count("*").alias("n"))
    return n.agg(F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.95).alias("p95"), F.max("n").alias("most"), (F.sum("n") / F.count("*")).alias("mean"))


_CAPS = {"src1": 12, "src2": 20}
_H17_CAP = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CAPS.items()) + " ELSE 0 END"
_H17_WORD = lambda w: f"contains({PHRASE_SQL}, ' {w} ')"
_H17_SQL = f"""WITH RECURSIVE {FEED}, texts AS (SELECT f.*, {PHRASE_SQL} AS phrase, string_split({KEY_SQL}, ' ') AS w FROM feed f),
  o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS k FROM texts) WHERE k = 1),
  sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, CAST(greatest(2, len(w) - 3) AS BIGINT)), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM o),
  grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets), links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.8),
  reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
  pool AS (SELECT doc_id, source, t // {10 * DAY} AS month, lang AS tag, {_H17_WORD('the')} AS wide, md5(doc_id || ':0') AS turn FROM o WHERE doc_id NOT IN (SELECT a FROM reach WHERE b < a)),
  why AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY turn, doc_id) AS x, row_number() OVER (PARTITION BY wide ORDER BY turn, doc_id) AS y FROM pool),
  marked AS (SELECT *, CASE WHEN x <= 5 THEN concat_ws(':', 'least', 'tag', tag) WHEN y <= 5 THEN 'least:wide:' || wide END AS reason FROM why),
  q AS (SELECT *, greatest(0, {_H17_CAP} - count(reason) OVER (PARTITION BY source)) AS need, count(*) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source, month) AS of FROM marked),
  r AS (SELECT *, row_number() OVER (PARTITION BY source, month ORDER BY turn, doc_id) <= floor(need * of / total) AS inside FROM q WHERE reason IS NULL),
  l AS (SELECT *, need - count_if(inside) OVER (PARTITION BY source) AS room, row_number() OVER (PARTITION BY source, inside ORDER BY turn, doc_id) AS z FROM r),
  sample AS (SELECT doc_id, source, month, reason FROM marked WHERE reason IS NOT NULL UNION ALL SELECT doc_id, source, month, concat_ws(':', 'fill', source, CASE WHEN inside THEN CAST(month AS VARCHAR) ELSE 'remainder' END) FROM l WHERE inside OR z <= room)
  SELECT 'H' || lpad(CAST(row_number() OVER (ORDER BY md5(doc_id || ':item'), doc_id) AS VARCHAR), 4, '0') AS item, doc_id, source, month, reason FROM sample"""


@query(_H17_SQL)
def h17_blind_sample(spark, d):
    rows = M.feed(spark, d).select("doc_id", "source", F.floor(F.col("t") / (10 * DAY)).alias("month"), F.col("lang").alias("tag"), X.has_word(F.col("text"), "the").alias("wide"), X.normal_key(F.col("text")).alias("plain"))
    one = dedupe.near_representatives(rows, "doc_id", F.sha1("plain"), X.word_hashes(F.col("plain")), columns=("source", "month", "tag", "wide"), of=X.word_runs)
    return features.blind_sample(one, "doc_id", ["tag", "wide"], "source", "month", 5, _CAPS)


@query(f"WITH {M.SCORED} SELECT 'severity' AS section, CAST(severity AS VARCHAR) AS name, CAST(count(*) AS DOUBLE) AS value FROM scored GROUP BY 2 UNION ALL SELECT 'ticker', ticker, avg(raw) FROM scored GROUP BY 2")
def h20_publish_metrics(spark, d):
    rows = M.scored(spark, d)
    levels = rows.groupBy(F.col("severity").cast("string").alias("name")).agg(F.count("*").cast("double").alias("value"))
    means = rows.groupBy(F.col("ticker").alias("name")).agg(F.avg("raw").alias("value"))
    return features.publish(spark, [("ticker", levels), ("severity", levels), ("ticker", means)])
