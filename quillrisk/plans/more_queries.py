"""Registered queries: feeds, snapshots, factor windows, capital, and session joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrisk.functions import text as X
from quillrisk.operators import dedupe, evaluation, feed, market, portfolio, totals
from quillrisk.plans import models as M
from quillrisk.plans.queries import KEY_SQL, PHRASE_SQL, query
from quillrisk.session import table

DAY = 86_400_000_000


_FEED_END = M.START + 365 * DAY
_UNION = f"""parts AS (SELECT 'news' AS source, doc_id AS id, {M.START} + doc_id * {M.QUARTER} AS t, text, lang AS ticker FROM documents
    UNION ALL SELECT 'social', conv_id * 1000 + turn, {M.START} + conv_id * {M.QUARTER} + turn * 60000000, text, role FROM conversations),
  fetched AS (SELECT *, row_number() OVER (PARTITION BY source, sha1({KEY_SQL}), ticker ORDER BY t, id) AS n FROM parts WHERE t < {_FEED_END})"""


def _built(spark, d):
    """News and social posts of a year."""
    news = M.feed(spark, d).select(F.col("doc_id").alias("id"), "t", "text", F.col("lang").alias("ticker"))
    turn = F.col("conv_id") * 1000 + F.col("turn")
    social = table(spark, d, "conversations").select(turn.alias("id"), (F.lit(M.START) + F.col("conv_id") * M.QUARTER + F.col("turn") * 60_000_000).alias("t"), "text", F.col("role").alias("ticker"))
    return feed.build_feed({"news": news, "social": social}, "id", "t", "text", "ticker", M.START, _FEED_END)


@query(f"WITH {_UNION} SELECT source, id, ticker, t FROM fetched WHERE n = 1")
def a15_build_feed(spark, d):
    return _built(spark, d).rows.select("source", "id", "ticker", "t")


@query(f"WITH {_UNION} SELECT source, count(*) AS fetched, count_if(n = 1) AS kept, count_if(n > 1) AS duplicates FROM fetched GROUP BY 1")
def a15_feed_stats(spark, d):
    return _built(spark, d).stats()


@query(f"""WITH {M.SCORED} SELECT ticker, day, seq, story_no FROM (SELECT ticker, t // {DAY} AS day, seq, dense_rank() OVER (PARTITION BY ticker ORDER BY story) AS story_no,
  row_number() OVER (PARTITION BY ticker, t // {DAY} ORDER BY t DESC, seq DESC) AS n FROM scored) WHERE n = 1""")
def a23_snapshot_export(spark, d):
    day = F.floor(F.col("t") / DAY)
    rows = M.scored(spark, d).withColumn("day", day)
    numbers = totals.places(rows.select("ticker", "story").distinct(), "ticker", "story", "story", "place").select("ticker", "story", (F.col("place") + 1).cast("int").alias("story_no"))
    rows = rows.join(numbers, ["ticker", "story"])
    last = F.row_number().over(Window.partitionBy("ticker", "day").orderBy(F.desc("t"), F.desc("seq")))
    return rows.withColumn("n", last).where("n = 1").select("ticker", "day", "seq", "story_no")


@query(f"SELECT doc_id, regexp_matches({PHRASE_SQL}, ' (the|der|les|los) ') AS wide FROM documents")
def b7_is_market_wide(spark, d):
    return M.documents(spark, d).select("doc_id", X.normal_phrase(F.col("text")).rlike(" (the|der|les|los) ").alias("wide"))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), ''), 'unknown') AS outlet, CASE WHEN url IS NULL OR url LIKE '%.com%' THEN 'US' ELSE 'EM' END AS region FROM pages")
def b16_derived_keys(spark, d):
    region = F.when(F.col("url").isNull() | F.contains("url", F.lit(".com")), "US").otherwise("EM")
    return table(spark, d, "pages").select("page_id", F.coalesce(X.url_host(F.col("url")), F.lit("unknown")).alias("outlet"), region.alias("region"))


@query(f"WITH {M.SCORED} SELECT seq, t < {M.BURN_IN_END} AS burn_in FROM scored")
def e9_burn_in_split(spark, d):
    return M.scored(spark, d).select("seq", (F.col("t") < M.BURN_IN_END).alias("burn_in"))


@query(f"""WITH {M.PRICES}, win(name, a, b) AS (VALUES ('w1', DATE '1996-03-06', DATE '1996-09-12'), ('w2', DATE '1998-01-01', DATE '1999-05-05')),
  s AS (SELECT name, symbol, max_by(close, session) FILTER (session <= a) AS x, max_by(close, session) FILTER (session <= b) AS y FROM prices, win GROUP BY 1, 2)
  SELECT name, symbol, y / x - 1 AS move FROM s""")
def f5_measure_window(spark, d):
    windows = spark.createDataFrame([("w1", "1996-03-06", "1996-09-12"), ("w2", "1998-01-01", "1999-05-05")], "name string, a string, b string")
    symbols = M.prices(spark, d).select("symbol").distinct()
    points = symbols.crossJoin(windows)  # a row a symbol and a named window
    points = points.select("symbol", "name", F.explode(F.array(F.struct(F.lit("x").alias("k"), F.to_date("a").alias("t")), F.struct(F.lit("y").alias("k"), F.to_date("b").alias("t")))).alias("p"))
    points = points.select("symbol", "name", "p.k", "p.t")
    series = M.prices(spark, d).select("symbol", F.col("session").alias("t"), F.col("close").alias("value"))
    found = market.asof_values(points, series).groupBy("name", "symbol").pivot("k", ["x", "y"]).agg(F.first("value"))
    return found.select("name", "symbol", (F.col("y") / F.col("x") - 1).alias("move"))


@query(f"WITH {M.SCORED} SELECT ticker, count(DISTINCT t // {DAY}) / (SELECT count(DISTINCT t // {DAY}) FROM scored) AS coverage FROM scored GROUP BY 1")
def f19_coverage(spark, d):
    rows = M.scored(spark, d).withColumn("day", F.floor(F.col("t") / DAY))
    days = rows.agg(F.count_distinct("day").alias("days"))
    return rows.groupBy("ticker").agg(F.count_distinct("day").alias("n")).crossJoin(days).select("ticker", (F.col("n") / F.col("days")).alias("coverage"))  # days: one row


@query(r"SELECT doc_id, CASE WHEN h > g THEN 'hawkish' WHEN g > h THEN 'growth' ELSE 'default' END AS scenario FROM (SELECT doc_id, len(regexp_extract_all(text, 'ing[ .,]')) AS h, len(regexp_extract_all(text, 'tion[ .,]')) AS g FROM documents)")
def g8_sub_scenario(spark, d):
    h, g = (F.regexp_count("text", F.lit(p)) for p in ("ing[ .,]", "tion[ .,]"))
    return M.documents(spark, d).select("doc_id", F.when(h > g, "hawkish").when(g > h, "growth").otherwise("default").alias("scenario"))


@query(f"WITH {M.PRICES}, m AS (SELECT symbol AS factor, year(session) % 3 AS run, year(session) AS analogue, max_by(close, session) / min_by(close, session) - 1 AS value FROM prices GROUP BY 1, 2, 3) SELECT run, factor, first(value ORDER BY abs(value) DESC, analogue) AS value FROM m GROUP BY 1, 2")
def g10_combine_scenarios(spark, d):
    rows = M.prices(spark, d).groupBy(F.col("symbol").alias("factor"), (F.year("session") % 3).alias("run"), F.year("session").alias("analogue"))
    rows = rows.agg((F.max_by("close", "session") / F.min_by("close", "session") - 1).alias("value")).withColumn("place", F.col("analogue"))
    return portfolio.strongest_moves(rows, ["run"]).select("run", "factor", "value")


@query(f"WITH {M.MENTIONS} SELECT seq, CASE WHEN region < 2 THEN 'Americas' WHEN region < 4 THEN 'Europe' ELSE 'Global' END || ':' || event_class AS key FROM mentions")
def g12_trigger_key(spark, d):
    macro = F.when(F.col("region") < 2, "Americas").when(F.col("region") < 4, "Europe").otherwise("Global")
    return M.mentions(spark, d).select("seq", F.concat(macro, F.lit(":"), "event_class").alias("key"))


#: Standardised risk weights by rating.
_CORPORATE = {"AAA": 0.2, "AA": 0.2, "A": 0.5, "BBB": 0.75, "BB": 1.0, "B": 1.5, "CCC": 1.5, "UNRATED": 1.0}
_SOVEREIGN = {"AAA": 0.0, "AA": 0.0, "A": 0.2, "BBB": 0.5, "BB": 1.0, "B": 1.0, "CCC": 1.5}
_EQUITY_WEIGHT = 2.5
_BY_RATING = lambda table, rest: "CASE rating " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {rest}::DOUBLE END"
_WEIGHTED = M.VALUED + f""", weighted AS (SELECT *, CASE WHEN instrument = 'sovereign_bond' THEN {_BY_RATING(_SOVEREIGN, 1.0)} WHEN asset_class = 'equity' THEN {_EQUITY_WEIGHT}::DOUBLE ELSE {_BY_RATING(_CORPORATE, 1.0)} END AS weight,
    CASE WHEN asset_class = 'loan' THEN ead WHEN asset_class IN ('bond', 'equity') THEN market_value ELSE greatest(market_value, 0.0::DOUBLE) END AS b,
    CASE WHEN asset_class = 'loan' THEN ead WHEN asset_class IN ('bond', 'equity') THEN market_value + pnl ELSE greatest(market_value + pnl, 0.0::DOUBLE) END AS a FROM valued)"""


def _capital(spark, d):
    values = portfolio.revalue(M.positions(spark, d), M.scenarios(spark), M.BBB_BP)
    return values, portfolio.risk_weight(_CORPORATE, _SOVEREIGN, _EQUITY_WEIGHT)


@query(f"""WITH {_WEIGHTED}, s AS (SELECT run, sum(b * weight) AS rwa_before, sum(a * weight) AS rwa_after, -sum(CASE WHEN asset_class <> 'loan' THEN pnl ELSE 0 END) AS from_mtm, sum(d_el) AS from_d_el FROM weighted GROUP BY 1)
  SELECT *, 0.13::DOUBLE * rwa_before AS cet1_before, from_mtm + from_d_el AS losses, 0.13::DOUBLE * rwa_before - (from_mtm + from_d_el) AS cet1_after, (0.13::DOUBLE * rwa_before - (from_mtm + from_d_el)) / rwa_after AS ratio_after FROM s""")
def g15_capital_view(spark, d):
    return portfolio.capital_view(*_capital(spark, d))


@query(f"WITH {_WEIGHTED} SELECT run, asset_class, weight, sum(b * weight) AS rwa_before, sum(a * weight) AS rwa_after FROM weighted GROUP BY 1, 2, 3")
def g15_assets_by_weight(spark, d):
    values, weight = _capital(spark, d)
    each = values.withColumn("weight", weight).groupBy("run", "asset_class", "weight")
    return each.agg(F.sum(portfolio.exposure(F.lit(0.0)) * F.col("weight")).alias("rwa_before"), F.sum(portfolio.exposure(F.col("pnl")) * F.col("weight")).alias("rwa_after"))


@query(f"WITH {M.SCORED}, {M.MARKET.split('WITH ')[-1]}, s AS (SELECT CAST(date_trunc('week', make_timestamp(t)) AS DATE) - 9499 AS session, max(severity) AS level FROM scored GROUP BY 1) SELECT level, count(*) AS n, avg(abs(market)) AS mean_move FROM s JOIN (SELECT DISTINCT session, market FROM market) USING (session) GROUP BY 1")
def h8_session_max_join(spark, d):
    week = F.date_sub(F.to_date(F.date_trunc("week", F.timestamp_micros("t"))), 9499)  # the stream's weeks over the prices' years
    levels = M.scored(spark, d).groupBy(week.alias("session")).agg(F.max("severity").alias("level"))
    moves = M.market(spark, d).select("session", "market").distinct()
    return levels.join(moves, "session").groupBy("level").agg(F.count("*").alias("n"), F.avg(F.abs("market")).alias("mean_move"))


@query(f"WITH {M.MARKET} SELECT DISTINCT session FROM market WHERE market <= -0.02::DOUBLE")
def h9_stress_days(spark, d):
    return M.market(spark, d).where("market <= -0.02").select("session").distinct()


@query(f"WITH {M.SCORED} SELECT ticker, count(*) AS mentions, count(DISTINCT story) AS stories, count_if(t % {DAY} >= 52200000000 AND t % {DAY} < 75600000000) AS in_session FROM scored GROUP BY 1")
def h15_pilot_report(spark, d):
    of_day = F.col("t") % DAY
    inside = (of_day >= 52_200_000_000) & (of_day < 75_600_000_000)
    return M.scored(spark, d).groupBy("ticker").agg(F.count("*").alias("mentions"), F.count_distinct("story").alias("stories"), F.count_if(inside).alias("in_session"))


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':0'), doc_id) AS n FROM documents WHERE {KEY_SQL} NOT IN (SELECT {KEY_SQL} FROM benchmark)) WHERE n <= 10")
def h18_link_check_sample(spark, d):
    pool = dedupe.exclude_texts(M.documents(spark, d), table(spark, d, "benchmark"), X.normal_key(F.col("text")))
    return evaluation.stratified_sample(pool, ["lang"], "doc_id", F.lit(10)).select("doc_id")


@query(f"WITH {M.PRICES}, c AS (SELECT symbol FROM prices GROUP BY 1 HAVING count(*) >= 100), n AS (SELECT o_orderpriority AS symbol, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, symbol LIMIT 3) SELECT symbol, n FROM n JOIN c USING (symbol)")
def h21_select_universe(spark, d):
    covered = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol").limit(3)
    enough = M.prices(spark, d).groupBy("symbol").agg(F.count("*").alias("days")).where("days >= 100").select("symbol")
    return covered.join(enough, "symbol").select("symbol", "n")


@query(f"""WITH {M.SCORED}, c AS (SELECT DISTINCT t // {DAY} AS day, (t // {DAY}) * {DAY} + 75600000000 AS close FROM scored)
  SELECT day, seq, rank FROM (SELECT c.day, s.seq, row_number() OVER (PARTITION BY c.day ORDER BY s.severity DESC, s.t, s.seq) AS rank FROM c JOIN scored s ON s.t > c.close - {DAY} AND s.t <= c.close) WHERE rank <= 8""")
def j6_evidence_before_close(spark, d):
    # (close - 24 h, close] holds each mention once: its day is that of the first close at or after it.
    day = F.floor((F.col("t") - 75_600_000_000 + DAY - 1) / DAY)
    rows = M.scored(spark, d)
    days = rows.select(F.floor(F.col("t") / DAY).alias("day")).distinct()
    near = rows.withColumn("day", day).join(days, "day", "left_semi")
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("severity"), "t", "seq"))
    return near.withColumn("rank", rank).where("rank <= 8").select("day", "seq", "rank")
