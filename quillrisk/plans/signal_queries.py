"""Registered queries: impact drivers, signals and market series."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrisk.operators import impact, market
from quillrisk.plans import models as M
from quillrisk.plans.queries import query
from quillrisk.session import table

H = impact.HOUR
_COUNTS = ", ".join(f"count(*) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND {6 * H * (29 - i) + 1} PRECEDING) AS c{i}" for i in range(28))
_DIFFS = [f"({f'c{i + 1}' if i < 27 else 'upto'} - c{i})" for i in range(28)]


@query(f"""WITH {M.MENTIONS}, c AS (SELECT seq, row_number() OVER (PARTITION BY ticker ORDER BY t, seq) AS place,
    count(*) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND {6 * H} PRECEDING) AS upto, {_COUNTS} FROM mentions WINDOW w AS (PARTITION BY ticker ORDER BY t)),
  m AS (SELECT seq, place - upto AS recent, ({' + '.join(_DIFFS)}) / 28.0::DOUBLE AS mean, ({' + '.join(f'{x} * {x}' for x in _DIFFS)}) / 28.0::DOUBLE AS square FROM c)
  SELECT seq, recent, (recent - mean) / greatest(sqrt(greatest(square - mean * mean, 0)), 1) AS z, 1 / (1 + exp(-(recent - mean) / greatest(sqrt(greatest(square - mean * mean, 0)), 1))) AS velocity FROM m""")
def e1_velocity(spark, d):
    return impact.velocity(M.mentions(spark, d), "ticker").select("seq", "recent", "z", "velocity")


@query(f"""WITH {M.MENTIONS}, b AS (SELECT a.seq, count(DISTINCT b.outlet) AS outlets FROM mentions a JOIN mentions b ON a.ticker = b.ticker AND b.t BETWEEN a.t - {6 * H} AND a.t GROUP BY 1)
  SELECT seq, CAST(outlets AS INTEGER) AS outlets, least(1.0, ln(1 + outlets) / ln(21)) AS breadth FROM b""")
def e2_breadth(spark, d):
    return impact.breadth(M.mentions(spark, d), "ticker", "outlet").select("seq", "outlets", "breadth")


_E3_SQL = f"""WITH v AS (SELECT vec_id AS seq, {M.START} + vec_id * {H} AS t, label, embedding FROM embeddings)
  SELECT a.seq, greatest(0.0, 1 - coalesce(max(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda x: x[1] * x[2]))), 0)) AS novelty
  FROM v a LEFT JOIN v b ON a.label = b.label AND b.t >= a.t - {72 * H} AND b.t < a.t GROUP BY 1"""


@query(_E3_SQL)
def e3_novelty(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), (F.lit(M.START) + F.col("vec_id") * H).alias("t"), "label", "embedding")
    return impact.novelty(rows, "label", "embedding", 72 * H)




def _drivers():
    return {"sentiment_strength": F.abs("sentiment"), "velocity": F.col("event_confidence"), "breadth": F.col("outlet") / 20, "novelty": F.lit(1.0), "credibility": F.lit(0.5)}


_RAW = "0.8::DOUBLE * (abs(sentiment) * 0.35::DOUBLE + event_confidence * 0.25::DOUBLE + outlet / 20 * 0.15::DOUBLE + 0.15::DOUBLE + 0.05::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * relevance)"


@query(f"WITH {M.MENTIONS} SELECT seq, {_RAW} AS raw FROM mentions")
def e5_raw_impact(spark, d):
    return M.mentions(spark, d).select("seq", impact.raw_impact(F.lit(0.8), _drivers(), F.col("relevance")).alias("raw"))


@query(f"WITH {M.MENTIONS} SELECT seq, 0.8::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * relevance) * abs(sentiment) * 0.35::DOUBLE AS from_sentiment, 0.8::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * relevance) * (outlet / 20) * 0.15::DOUBLE AS from_breadth FROM mentions")
def e6_contributions(spark, d):
    parts = impact.contributions(F.lit(0.8), _drivers(), F.col("relevance"))
    return M.mentions(spark, d).select("seq", parts["sentiment_strength"].alias("from_sentiment"), parts["breadth"].alias("from_breadth"))


_Q = [0.5, 0.75, 0.9, 0.97]


@query(f"WITH {M.SCORED}, q AS (SELECT ticker, quantile_cont(raw, {_Q}) AS e FROM scored WHERE t < {M.BURN_IN_END} GROUP BY 1) SELECT ticker, e[1] AS e1, e[2] AS e2, e[3] AS e3, e[4] AS e4 FROM q")
def e7_fit_bins(spark, d):
    edges = impact.fit_bins(M.scored(spark, d).where(F.col("t") < M.BURN_IN_END), "ticker", "raw", _Q)
    return edges.select("ticker", *[F.col("edges")[i].alias(f"e{i + 1}") for i in range(4)])


@query(f"""WITH {M.SCORED}, q AS (SELECT ticker, quantile_cont(raw, {_Q}) AS e FROM scored WHERE t < {M.BURN_IN_END} GROUP BY 1)
  SELECT seq, CAST(1 + len(list_filter(e, lambda x: x <= raw)) AS INTEGER) AS severity FROM scored JOIN q USING (ticker)""")
def e8_apply_bins(spark, d):
    rows = M.scored(spark, d).drop("severity")
    edges = impact.fit_bins(rows.where(F.col("t") < M.BURN_IN_END), "ticker", "raw", _Q)
    return impact.apply_bins(rows, edges, "ticker", "raw").select("seq", "severity")


def _sessions(spark, d):
    days = table(spark, d, "events").select(F.to_date("ts").alias("session")).distinct()
    return days.where(~F.dayofweek("session").isin(1, 7))


@query("""WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS session FROM events WHERE isodow(ts) <= 5), e AS (SELECT event_id, ts - INTERVAL 5 HOUR AS l FROM events),
  d AS (SELECT event_id, CAST(l AS DATE) + CASE WHEN hour(l) >= 16 THEN 1 ELSE 0 END AS day FROM e)
  SELECT event_id AS seq, coalesce((SELECT min(session) FROM s WHERE session >= CAST(d.day AS DATE)), (SELECT max(session) FROM s)) AS session FROM d""")
def e10_market_session(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    return impact.market_session(F.col("ts"), _sessions(spark, d), rows).select("seq", "session")


@query(f"""WITH {M.MENTIONS} SELECT seq, max(abs(sentiment)) OVER w AS max_strength, ln(1 + count(*) OVER w) AS log_count FROM mentions
  WINDOW w AS (PARTITION BY ticker, t // 86400000000 ORDER BY t, seq ROWS UNBOUNDED PRECEDING)""")
def e11_session_running_max(spark, d):
    rows = M.mentions(spark, d).withColumn("session", F.floor(F.col("t") / 86_400_000_000)).withColumn("strength", F.abs("sentiment"))
    return impact.session_running_max(rows, "ticker", ["strength"]).select("seq", "max_strength", "log_count")


@query(f"""WITH {M.MENTIONS}, e AS (SELECT a.seq, sum(w * s * p) AS num, sum(w * p) AS den FROM (SELECT a.seq, b.sentiment AS s,
    greatest(b.relevance, 0.001::DOUBLE) * greatest(b.event_confidence, 0.1::DOUBLE) AS w, pow(2.0::DOUBLE, (b.t - a.t) / {6 * H}.0::DOUBLE) AS p
    FROM mentions a JOIN mentions b ON a.ticker = b.ticker AND (b.t < a.t OR (b.t = a.t AND b.seq <= a.seq)) AND b.t > a.t - {6 * H * 70}) a GROUP BY 1)
  SELECT seq, num / den AS level, 1 - exp(-den / 3) AS confidence FROM e""")
def e14_ewma_state(spark, d):
    weight = F.greatest("relevance", F.lit(0.001)) * F.greatest("event_confidence", F.lit(0.1))
    return impact.ewma(M.mentions(spark, d), "ticker", "sentiment", weight, 6 * H).select("seq", "level", "confidence")


@query(f"""WITH {M.SCORED}, n AS (SELECT *, (t - {M.START}) // {H} AS step, row_number() OVER (PARTITION BY ticker ORDER BY t, seq) AS n FROM scored),
  ends AS (SELECT ticker, step, max(n) AS e, CASE WHEN step = (SELECT max(step) FROM n) THEN (SELECT max(t) FROM n) ELSE {M.START} + (step + 1) * {H} END AS as_of FROM n GROUP BY 1, 2),
  near AS (SELECT e.ticker, e.step, n.* EXCLUDE (ticker, step), row_number() OVER (PARTITION BY e.ticker, e.step ORDER BY raw DESC, seq) AS k FROM ends e JOIN n ON e.ticker = n.ticker AND n.n <= e.e AND n.n > e.e - 50),
  votes AS (SELECT ticker, step, event_class, count(*) AS v, min(n) AS f FROM near GROUP BY 1, 2, 3),
  modal AS (SELECT ticker, step, first(event_class ORDER BY v DESC, f) AS modal_class FROM votes GROUP BY 1, 2),
  sums AS (SELECT e.ticker, e.step, sum(w * p * sentiment) AS num, sum(w * p) AS den FROM (SELECT e.ticker, e.step, n.sentiment, greatest(n.relevance, 0.001::DOUBLE) * greatest(n.event_confidence, 0.1::DOUBLE) AS w,
    pow(2.0::DOUBLE, (n.t - e.as_of) / {6 * H}.0::DOUBLE) AS p FROM ends e JOIN n ON e.ticker = n.ticker AND n.n <= e.e AND n.t > e.as_of - {6 * H * 70}) e GROUP BY 1, 2)
  SELECT ticker, step, any_value(as_of) AS as_of, count(*) AS mentions, count(DISTINCT outlet) AS outlets, first(seq ORDER BY k) AS top_seq, first(severity ORDER BY k) AS impact, first(event_confidence ORDER BY k) AS top_confidence,
    any_value(modal_class) AS modal_class, array_to_string(list(seq ORDER BY k) FILTER (k <= 5), ',') AS evidence, array_to_string(list_sort(list_distinct(list(region))), ',') AS regions,
    any_value(num / den) AS sentiment, any_value(1 - exp(-den / 3)) AS confidence
  FROM near JOIN modal USING (ticker, step) JOIN sums USING (ticker, step) JOIN ends USING (ticker, step) GROUP BY ticker, step""")
def e15_entity_signals(spark, d):
    out = impact.entity_signals(M.scored(spark, d), "ticker", M.START)
    return out.select(
        "ticker", "step", "as_of", "mentions", "outlets", "top_seq", "impact", "top_confidence", "modal_class", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"),
        F.array_join(F.col("regions").cast("array<string>"), ",").alias("regions"), "sentiment", "confidence",
    )


#: Sectors of the tickers; one ticker has none.
_SECTORS = {"error": "Financials", "purchase": "Retail", "signup": "Technology", "click": "Technology"}
_SECTOR_OF = "CASE ticker " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SECTORS.items()) + " END"


@query(f"""WITH {M.SCORED}, votes AS (SELECT story, event_class, sum(event_confidence) AS w, min(seq) AS f, max(event_confidence) AS surest FROM scored GROUP BY 1, 2),
  modal AS (SELECT story, first(event_class ORDER BY round(w, 9) DESC, f) AS event_class, first(w ORDER BY round(w, 9) DESC, f) / greatest(sum(w), 1e-9) AS share, first(surest ORDER BY round(w, 9) DESC, f) AS surest FROM votes GROUP BY 1),
  best AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY raw DESC, seq) AS k FROM scored),
  facts AS (SELECT story, count(*) AS mentions, avg(sentiment) AS sentiment, first(severity ORDER BY k) AS top, count(DISTINCT outlet) AS outlets, list_sort(list_distinct(list(ticker))) AS tickers,
    array_to_string(list_sort(list_distinct(list(region))), ',') AS regions, array_to_string(list_sort(list_distinct(list({_SECTOR_OF}) FILTER ({_SECTOR_OF} IS NOT NULL))), ',') AS sectors,
    array_to_string(list(seq ORDER BY k) FILTER (k <= 5), ',') AS evidence FROM best GROUP BY 1)
  SELECT story, event_class, mentions, sentiment, outlets, array_to_string(tickers, ',') AS tickers, regions, coalesce(sectors, '') AS sectors, CASE WHEN len(tickers) = 1 THEN tickers[1] END AS entity,
    CAST(least(10, top + CASE WHEN outlets >= 10 THEN 2 WHEN outlets >= 5 THEN 1 ELSE 0 END) AS INTEGER) AS impact, share * surest AS event_confidence, share * (1 - exp(-mentions / 3.0::DOUBLE)) AS confidence, evidence FROM facts JOIN modal USING (story)""")
def e16_event_signals(spark, d):
    out = impact.event_signals(M.scored(spark, d), "story", _SECTORS)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("story", "event_class", "mentions", "sentiment", "outlets", text("tickers"), text("regions"), text("sectors"), "entity", "impact", "event_confidence", "confidence", text("evidence"))


@query(f"""WITH {M.SCORED} SELECT ticker, array_to_string(list(seq ORDER BY n), ',') AS seqs FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY raw DESC, seq) AS n FROM scored) WHERE n <= 5 GROUP BY 1""")
def e17_top_evidence(spark, d):
    best = impact.top_evidence(M.scored(spark, d), ["ticker"], "raw", ["seq"])
    return best.select("ticker", F.array_join(F.transform("evidence", lambda e: e["seq"].cast("string")), ",").alias("seqs"))


@query(f"""WITH {M.SCORED}, s AS (SELECT a.story, a.seq, a.t, max(b.severity) AS impact, least(20, count(DISTINCT b.outlet)) AS outlets, count(*) AS n FROM scored a JOIN scored b ON a.story = b.story AND (b.t < a.t OR (b.t = a.t AND b.seq <= a.seq)) GROUP BY 1, 2, 3),
  p AS (SELECT *, lag(impact) OVER w AS li, lag(outlets) OVER w AS lo FROM s WHERE n >= 2 WINDOW w AS (PARTITION BY story ORDER BY t, seq))
  SELECT story, seq, impact, CAST(outlets AS INTEGER) AS outlets FROM p WHERE li IS NULL OR li <> impact OR lo <> outlets""")
def e18_event_updates(spark, d):
    return impact.event_updates(M.scored(spark, d), "story")


@query(f"WITH {M.MENTIONS} SELECT seq, 'sig_' || substr(sha1(concat_ws('|', ticker, seq, t)), 1, 16) AS id FROM mentions")
def e19_signal_id(spark, d):
    return M.mentions(spark, d).select("seq", impact.signal_id(F.col("ticker"), F.col("seq").cast("string"), F.col("t").cast("string")).alias("id"))


@query(f"WITH {M.SCORED} SELECT count_if(severity NOT BETWEEN 1 AND 10) AS bad_severity, count_if(abs(sentiment) > 1) AS bad_sentiment, count(*) AS n FROM scored")
def e20_validate_signals(spark, d):
    rows = M.scored(spark, d)
    return rows.agg(F.count_if(~F.col("severity").between(1, 10)).alias("bad_severity"), F.count_if(F.abs("sentiment") > 1).alias("bad_sentiment"), F.count("*").alias("n"))


# --- market ---
@query("SELECT session, epoch_us(CAST(session AS TIMESTAMP) + INTERVAL 21 HOUR) AS close_us FROM (SELECT DISTINCT CAST(ts AS DATE) AS session FROM events WHERE isodow(ts) <= 5)")
def f1_close_times(spark, d):
    return market.close_times(_sessions(spark, d)).select("session", F.unix_micros("close").alias("close_us"))


@query(f"WITH {M.MARKET} SELECT symbol, session, ret FROM market")
def f3_returns(spark, d):
    return M.market(spark, d).select("symbol", "session", "ret")


@query(f"""WITH {M.PRICES}, pts AS (SELECT DISTINCT o_orderdate AS day, o_orderpriority AS symbol FROM orders)
  SELECT p.symbol, CAST(p.day AS DATE) AS t, max_by(x.close, x.session) AS value FROM pts p LEFT JOIN prices x ON x.symbol = p.symbol AND x.session <= CAST(p.day AS DATE) GROUP BY 1, 2""")
def f4_asof_value(spark, d):
    points = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("t"), F.col("o_orderpriority").alias("symbol")).distinct()
    series = M.prices(spark, d).select("symbol", F.col("session").alias("t"), F.col("close").alias("value"))
    return market.asof_values(points, series).select("symbol", "t", "value")


@query(f"""WITH {M.MARKET}, f AS (SELECT symbol, session, n, ret, market, regr_slope(CASE WHEN market IS NOT NULL THEN ret END, CASE WHEN ret IS NOT NULL THEN market END) OVER w AS b,
    regr_intercept(CASE WHEN market IS NOT NULL THEN ret END, CASE WHEN ret IS NOT NULL THEN market END) OVER w AS a, count(CASE WHEN market IS NOT NULL THEN ret END) OVER w AS used,
    lead(ret) OVER o AS r1, lead(market) OVER o AS m1 FROM market WINDOW o AS (PARTITION BY symbol ORDER BY n), w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 120 PRECEDING AND 21 PRECEDING))
  SELECT symbol, session, CASE WHEN used >= 60 THEN ret - (a + b * market) + r1 - (a + b * m1) END AS car FROM f""")
def f6_event_study(spark, d):
    return market.event_study(M.market(spark, d)).select("symbol", "session", "car")


@query(f"""WITH {M.MARKET} SELECT symbol, session, CASE WHEN volume > 0 AND u > 0 THEN ln(volume / u) END AS abnormal_volume FROM (SELECT *, avg(volume) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN 30 PRECEDING AND 6 PRECEDING) AS u FROM market)""")
def f7_abnormal_volume(spark, d):
    return market.abnormal_volume(M.market(spark, d)).select("symbol", "session", "abnormal_volume")


@query(f"WITH {M.SCORED} SELECT ticker, t // 86400000000 AS day, max(abs(sentiment)) AS strength, ln(1 + count(*)) AS log_n, count(DISTINCT story) AS stories FROM scored GROUP BY 1, 2")
def f8_ticker_days(spark, d):
    rows = M.scored(spark, d).groupBy("ticker", F.floor(F.col("t") / 86_400_000_000).alias("day"))
    return rows.agg(F.max(F.abs("sentiment")).alias("strength"), F.log1p(F.count("*").cast("double")).alias("log_n"), F.count_distinct("story").alias("stories"))


_IC = f"""WITH {M.MARKET}, j AS (SELECT session, ret, volume FROM market WHERE ret IS NOT NULL),
  r AS (SELECT session, rank() OVER (PARTITION BY session ORDER BY ret) + (count(*) OVER (PARTITION BY session, ret) - 1) / 2 AS a, rank() OVER (PARTITION BY session ORDER BY volume) + (count(*) OVER (PARTITION BY session, volume) - 1) / 2 AS b FROM j),
  ic AS (SELECT session, corr(a, b) AS ic, count(*) AS names FROM r GROUP BY 1 HAVING count(*) >= 5)"""


@query(_IC + " SELECT count(*) AS days, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t_stat, avg(CAST(ic > 1e-12 AS INTEGER)) AS positive FROM ic WHERE ic IS NOT NULL AND NOT isnan(ic)")
def f9_information_coefficient(spark, d):
    return market.information_coefficient(market.daily_spearman(M.market(spark, d), "session", "ret", "volume"))


@query(f"""WITH {M.MARKET}, w AS (SELECT symbol, n, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY n)) AS w FROM market WHERE ret IS NOT NULL),
  f AS (SELECT *, w / max(w) OVER (PARTITION BY symbol ORDER BY n) - 1 AS f FROM w)
  SELECT symbol, exp(sum(ln(1 + ret))) - 1 AS total, exp(sum(ln(1 + ret)) * 52 / count(*)) - 1 AS annual, stddev_samp(ret) * sqrt(52) AS volatility, avg(ret) * 52 / (stddev_samp(ret) * sqrt(52)) AS sharpe, min(f) AS drawdown FROM f GROUP BY 1""")
def f10_performance(spark, d):
    return market.performance(M.market(spark, d).where("ret IS NOT NULL"), "symbol", "ret", 52)


_TILT = f"""WITH {M.MARKET}, t AS (SELECT session, symbol, 0.2::DOUBLE * exp(2.0::DOUBLE * CASE WHEN abs(ret) < 0.05::DOUBLE THEN 0.0 ELSE ret END * 0.5::DOUBLE) AS w FROM market WHERE ret IS NOT NULL),
  tilted AS (SELECT session, symbol, w / sum(w) OVER (PARTITION BY session) AS weight FROM t)"""


def _tilt(spark, d):
    rows = M.market(spark, d).where("ret IS NOT NULL").select("session", "symbol", "ret", F.lit(0.2).alias("base"), F.lit(0.5).alias("sure"))
    return market.tilt_weights(rows, "session", "base", "ret", "sure", 2.0, 0.05)


@query(_TILT + " SELECT session, symbol, weight FROM tilted")
def f12_target_weights(spark, d):
    return _tilt(spark, d).select("session", "symbol", "weight")


@query()
def f13_cap_weights(spark, d):
    return market.cap_weights(_tilt(spark, d), "session", "weight", 0.18, 0.22).select("session", "symbol", "weight", "capped")


@query(_TILT + """, x AS (SELECT *, sum(abs(weight - 0.2::DOUBLE)) OVER (PARTITION BY session) / 2 AS turn FROM tilted)
  SELECT session, symbol, 0.2::DOUBLE + CASE WHEN turn > 0 THEN least(1.0::DOUBLE, 0.01::DOUBLE / turn) ELSE 1.0 END * (weight - 0.2::DOUBLE) AS after, turn * CASE WHEN turn > 0 THEN least(1.0::DOUBLE, 0.01::DOUBLE / turn) ELSE 1.0 END AS turnover FROM x""")
def f14_rebalance(spark, d):
    out = market.rebalance(_tilt(spark, d).withColumn("held", F.lit(0.2)), "session", "held", "weight", 0.01, 5)
    return out.select("session", "symbol", "after", "turnover")


@query(f"""WITH {M.MARKET}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC) AS k FROM market WHERE ret IS NOT NULL AND market IS NOT NULL)
  SELECT symbol, stddev_samp(ret) * sqrt(52) AS volatility, covar_samp(ret, market) / var_samp(market) AS beta FROM l WHERE k <= 252 GROUP BY 1""")
def f18_vol_beta(spark, d):
    return market.beta_and_vol(M.market(spark, d), "symbol", "ret", "market", 252, 52)


@query(f"WITH {M.MARKET} SELECT symbol, session, CASE WHEN n >= 20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS rolling FROM market")
def f20_rolling_mean(spark, d):
    return market.rolling_mean(M.market(spark, d), "symbol", "close").select("symbol", "session", "rolling")


# --- reports over signals ---
@query(f"WITH {M.SCORED} SELECT ticker, max(severity) AS severity, first(seq ORDER BY t DESC, seq DESC) AS seq FROM scored GROUP BY 1")
def i11_latest_per_entity(spark, d):
    return M.scored(spark, d).groupBy("ticker").agg(F.max("severity").alias("severity"), F.max_by("seq", F.struct("t", "seq")).alias("seq"))


@query(f"WITH {M.SCORED} SELECT count(*) AS mentions, count(DISTINCT story) AS stories, count_if(severity >= 5) AS strong FROM scored WHERE ticker IN ('error', 'purchase')")
def j1_signal_filters(spark, d):
    rows = M.scored(spark, d).where(F.col("ticker").isin("error", "purchase"))
    return rows.agg(F.count("*").alias("mentions"), F.count_distinct("story").alias("stories"), F.count_if(F.col("severity") >= 5).alias("strong"))


@query(f"WITH {M.SCORED} SELECT ticker, t // 86400000000 AS day, max(severity) AS severity FROM scored GROUP BY 1, 2")
def j2_impact_heatmap(spark, d):
    return M.scored(spark, d).groupBy("ticker", F.floor(F.col("t") / 86_400_000_000).alias("day")).agg(F.max("severity").alias("severity"))


@query(f"WITH {M.SCORED} SELECT story, seq, severity FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY severity DESC, t, seq) AS n FROM scored) WHERE n = 1 ORDER BY severity DESC, seq LIMIT 200")
def j3_best_signal_per_event(spark, d):
    best = M.scored(spark, d).groupBy("story").agg(F.min_by(F.struct("seq", "severity"), F.struct(-F.col("severity"), "t", "seq")).alias("b"))
    return best.select("story", "b.seq", "b.severity").orderBy(F.desc("severity"), "seq").limit(200)


@query(f"WITH {M.SCORED} SELECT ticker, seq, n FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY severity DESC, outlet DESC, seq) AS n FROM scored) WHERE n <= 3")
def j4_rank_in_group(spark, d):
    n = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("severity"), F.desc("outlet"), "seq"))
    return M.scored(spark, d).withColumn("n", n).where("n <= 3").select("ticker", "seq", "n")


@query(f"WITH {M.SCORED} SELECT t // 86400000000 AS day, count(*) AS n FROM scored WHERE severity >= 5 GROUP BY 1 ORDER BY n DESC, day LIMIT 6")
def j5_busiest_days(spark, d):
    rows = M.scored(spark, d).where("severity >= 5").groupBy(F.floor(F.col("t") / 86_400_000_000).alias("day")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "day").limit(6)
