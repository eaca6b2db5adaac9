"""Registered queries: merchants, positions, stress, evaluation and feed statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrisk.functions import text as X
from quillrisk.operators import evaluation, portfolio
from quillrisk.plans import models as M
from quillrisk.plans.queries import FEED, HITS, NEGATIVE, POSITIVE, query
from quillrisk.session import table

DAY = 86_400_000_000
MERCHANTS = "m AS (SELECT o_custkey AS merchant, strftime(o_orderdate, '%Y-%m') AS month, CAST(o_totalprice AS DOUBLE) AS amount, o_orderpriority AS code FROM orders)"
ROLLUP = MERCHANTS + """, months AS (SELECT merchant, month, sum(CAST(round(amount * 100) AS BIGINT)) / 100 AS total, CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM m GROUP BY 1, 2),
  sums AS (SELECT merchant, sum(cents) / 100 AS volume, count(*) AS months, sum(cents) / count(*) / 100 AS mean, stddev_samp(total) AS std, CAST(sum(n) AS BIGINT) AS transactions FROM months GROUP BY 1),
  codes AS (SELECT merchant, code, count(*) AS n FROM m GROUP BY 1, 2), modal AS (SELECT merchant, first(code ORDER BY n DESC, code DESC) AS code FROM codes GROUP BY 1),
  rolled AS (SELECT merchant, volume, months, mean, std, transactions, std / mean AS variation, code FROM sums LEFT JOIN modal USING (merchant))"""


@query(f"WITH {ROLLUP} SELECT * FROM rolled")
def g1_merchant_rollup(spark, d):
    return portfolio.merchant_rollup(M.merchants(spark, d))


def _sectors(spark, d):
    return portfolio.merchant_rollup(M.merchants(spark, d)).withColumnRenamed("code", "sector")


@query(f"""WITH {ROLLUP}, a AS (SELECT code AS sector, greatest(3, CAST(round_even(sqrt(sum(volume)) / sum(sqrt(sum(volume))) OVER () * 60, 0) AS INTEGER)) AS alloc FROM rolled GROUP BY 1)
  SELECT sector, merchant, rank FROM (SELECT code AS sector, merchant, row_number() OVER (PARTITION BY code ORDER BY volume DESC, merchant) AS rank FROM rolled) JOIN a USING (sector) WHERE rank <= alloc""")
def g2_select_top_per_sector(spark, d):
    return portfolio.top_per_sector(_sectors(spark, d), 60, 3).select("sector", "merchant", "rank")


@query(f"""WITH {ROLLUP}, p AS (SELECT merchant, (row_number() OVER (PARTITION BY code ORDER BY variation, merchant) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY code) AS q FROM rolled WHERE variation IS NOT NULL)
  SELECT merchant, CASE WHEN q < 0.25::DOUBLE THEN 'A' WHEN q < 0.75::DOUBLE THEN 'BBB' ELSE 'B' END AS rating FROM p""")
def g3_rating_by_rank(spark, d):
    rows = _sectors(spark, d).where("variation IS NOT NULL")
    return portfolio.rating_by_rank(rows, "variation", [("A", 0.25), ("BBB", 0.5), ("B", 0.25)]).select("merchant", "rating")


@query(f"""WITH {M.POSITIONS}, n AS (SELECT DISTINCT maturity, greatest(1, CAST(round_even(maturity * 2, 0) AS INTEGER)) AS n FROM positions),
  k AS (SELECT maturity, n, unnest(range(1, n + 1)) AS k FROM n), v AS (SELECT maturity, k / 2.0::DOUBLE AS t, (0.02::DOUBLE + CASE WHEN k = n THEN 1.0::DOUBLE ELSE 0.0 END) / pow(1.015::DOUBLE, k) AS v FROM k)
  SELECT position, b.price, b.duration, b.convexity FROM positions JOIN (SELECT maturity, sum(v) AS price, sum(v * t) / sum(v) / 1.015::DOUBLE AS duration, sum(v * t * (t + 0.5::DOUBLE)) / sum(v) / (1.015::DOUBLE * 1.015::DOUBLE) AS convexity FROM v GROUP BY 1) b USING (maturity)""")
def g4_bond_analytics(spark, d):
    out = portfolio.bond_analytics(F.lit(0.04), F.lit(0.03), F.col("maturity"))
    return M.positions(spark, d).select("position", out.alias("b")).select("position", "b.price", "b.duration", "b.convexity")


_PAID = "list_sum(list_transform(range(1, CAST(greatest(1, round_even(maturity * {f}, 0)) AS INTEGER) + 1), lambda k: {value})) / {f}"
_ANNUITY = _PAID.format(f=2, value="pow(1.015::DOUBLE, -k)")


@query(f"WITH {M.POSITIONS} SELECT position, {_ANNUITY} AS annuity, notional * ({_ANNUITY}) * 0.0001::DOUBLE AS dv01 FROM positions")
def g5_annuity(spark, d):
    rate, years = F.lit(0.03), F.col("maturity")
    return M.positions(spark, d).select("position", portfolio.annuity(rate, years).alias("annuity"), portfolio.swap_dv01(F.col("notional"), rate, years).alias("dv01"))


@query(f"""WITH {M.POSITIONS} SELECT position, {_PAID.format(f=4, value="exp(-(0.02::DOUBLE + spread_ratio * 0.01::DOUBLE / greatest(lgd, 0.000001::DOUBLE)) * (k / 4))")} AS duration FROM positions""")
def g5_cds_risky_duration(spark, d):
    out = portfolio.cds_risky_duration(F.col("spread_ratio") * 0.01, F.col("lgd"), F.lit(0.02), F.col("maturity"))
    return M.positions(spark, d).select("position", out.alias("duration"))


@query(f"WITH {M.POSITIONS} SELECT position, CASE WHEN maturity <= 0.25 THEN 0.01::DOUBLE WHEN maturity >= 10 THEN 0.025::DOUBLE ELSE 0.01::DOUBLE + (0.025::DOUBLE - 0.01::DOUBLE) * (maturity - 0.25::DOUBLE) / 9.75::DOUBLE END AS rate FROM positions")
def g5_curve_rate(spark, d):
    return M.positions(spark, d).select("position", portfolio.curve_rate(F.col("maturity"), F.lit(0.01), F.lit(0.025)).alias("rate"))


_CDF = "CASE WHEN {x} >= 0 THEN 1 - {t} ELSE {t} END"
_TAIL = "exp(-{x} * {x} / 2) * 0.3989422804014327::DOUBLE * k * (0.319381530::DOUBLE + k * (-0.356563782::DOUBLE + k * (1.781477937::DOUBLE + k * (-1.821255978::DOUBLE + k * 1.330274429::DOUBLE))))"


def _cdf(x: str) -> str:
    tail = _TAIL.replace("k", f"(1 / (1 + 0.2316419::DOUBLE * abs({x})))").format(x=x)
    return _CDF.format(x=x, t=f"({tail})")


@query(f"""WITH {M.POSITIONS}, o AS (SELECT position, short, 95 + beta * 10 AS strike, maturity AS years FROM positions),
  d AS (SELECT *, (ln(100 / strike) + (0.02::DOUBLE + 0.5::DOUBLE * 0.25::DOUBLE * 0.25::DOUBLE) * years) / (0.25::DOUBLE * sqrt(years)) AS d1, 0.25::DOUBLE * sqrt(years) AS root, strike * exp(-0.02::DOUBLE * years) AS paid FROM o),
  c AS (SELECT *, {_cdf('d1')} AS up, {_cdf('(d1 - root)')} AS up2, {_cdf('(root - d1)')} AS down2, {_cdf('(-d1)')} AS down, exp(-d1 * d1 / 2) * 0.3989422804014327::DOUBLE AS density FROM d)
  SELECT position, CASE WHEN short THEN paid * down2 - 100 * down ELSE 100 * up - paid * up2 END AS price, up - CASE WHEN short THEN 1 ELSE 0 END AS delta, density / (100 * root) AS gamma, 100 * density * sqrt(years) AS vega FROM c""")
def g5_black_scholes(spark, d):
    out = portfolio.black_scholes(F.lit(100.0), F.lit(95.0) + F.col("beta") * 10, F.col("maturity"), F.lit(0.02), F.lit(0.25), ~F.col("short"))
    return M.positions(spark, d).select("position", out.alias("o")).select("position", "o.price", "o.delta", "o.gamma", "o.vega")


MOVES = f"""moves AS (SELECT symbol AS factor, year(session) AS analogue, max_by(close, session) / min_by(close, session) - 1 AS value FROM prices GROUP BY 1, 2)"""


def _moves(spark, d):
    rows = M.prices(spark, d).groupBy(F.col("symbol").alias("factor"), F.year("session").alias("analogue"))
    return rows.agg((F.max_by("close", "session") / F.min_by("close", "session") - 1).alias("value"))


@query(f"WITH {M.PRICES}, {MOVES} SELECT analogue, factor, value FROM moves")
def g6_calibrate_scenarios(spark, d):
    return _moves(spark, d).select("analogue", "factor", "value")


@query(f"WITH {M.PRICES}, {MOVES} SELECT factor, first(value ORDER BY abs(value) DESC, analogue) AS value, first(analogue ORDER BY abs(value) DESC, analogue) AS driver FROM moves GROUP BY 1")
def g7_build_scenario(spark, d):
    rows = _moves(spark, d).withColumn("place", F.col("analogue")).withColumn("run", F.lit(1))
    return portfolio.strongest_moves(rows, ["run"]).select("factor", "value", "driver")


@query(f"WITH {M.SCORED} SELECT seq, CAST(CASE WHEN severity < 2 THEN 0.0 WHEN severity = 2 THEN 0.5 WHEN severity = 3 THEN 0.75 ELSE 1.0 END AS DOUBLE) AS multiplier FROM scored")
def g9_severity_multiplier(spark, d):
    return M.scored(spark, d).select("seq", portfolio.severity_multiplier(F.col("severity"), {2: 0.5, 3: 0.75, 4: 1.0}).alias("multiplier"))


SIGNALS = M.SCORED + """, signals AS (SELECT seq, t, ticker, severity + 4 AS impact, event_confidence AS confidence, outlet % 4 AS outlets, sentiment FROM scored),
  gated AS (SELECT *, CASE WHEN impact < 8 THEN 'impact' WHEN confidence < 0.6::DOUBLE THEN 'confidence' WHEN outlets < 2 THEN 'sources' WHEN sentiment >= -0.15::DOUBLE THEN 'sentiment' ELSE 'pass' END AS reason FROM signals)"""


def _signals(spark, d):
    rows = M.scored(spark, d)
    return rows.select("seq", "t", "ticker", (F.col("severity") + 4).alias("impact"), F.col("event_confidence").alias("confidence"), (F.col("outlet") % 4).alias("outlets"), "sentiment")


@query(f"WITH {SIGNALS} SELECT seq, reason FROM gated")
def g13_trigger_gates(spark, d):
    return portfolio.trigger_gates(_signals(spark, d)).select("seq", "reason")


def cooldown_sql(rows: str) -> str:
    """Recursive tables ``p`` and ``f``: the cooldown over ``rows (ticker, t, seq, impact)``, a row at a time."""
    return f"""p AS (SELECT ticker, t, seq, impact, row_number() OVER (PARTITION BY ticker ORDER BY t, seq) AS n FROM ({rows})),
  f AS (SELECT ticker, n, seq, impact, t AS since, impact AS level, 'fired' AS decision FROM p WHERE n = 1 UNION ALL
    SELECT ticker, n, seq, impact, CASE WHEN d = 'cooldown' THEN since ELSE t END, CASE WHEN d = 'cooldown' THEN level ELSE impact END, d FROM (
      SELECT p.ticker, p.n, p.seq, p.impact, p.t, f.since, f.level, CASE WHEN p.t - f.since >= {DAY} THEN 'fired' WHEN p.impact > f.level THEN 'escalation' ELSE 'cooldown' END AS d FROM f JOIN p ON p.ticker = f.ticker AND p.n = f.n + 1))"""


@query(f"WITH RECURSIVE {SIGNALS}, {cooldown_sql("SELECT * FROM gated WHERE reason = 'pass'")} SELECT seq, ticker, impact, decision FROM f")
def g13_stress_trigger(spark, d):
    passed = portfolio.trigger_gates(_signals(spark, d)).where("reason = 'pass'")
    return portfolio.cooldown(passed, "ticker").select("seq", "ticker", "impact", "decision")


def _valued(spark, d, moves=M.SCENARIOS):
    return portfolio.revalue(M.positions(spark, d), M.scenarios(spark, moves), M.BBB_BP)


@query(f"WITH {M.VALUED} SELECT run, position, pnl, loan_fv, pd_stressed, d_el FROM valued")
def g14_revalue(spark, d):
    return _valued(spark, d).select("run", "position", "pnl", "loan_fv", "pd_stressed", "d_el")


_CLASS_MOVES = {
    "CREDIT_EVENT": {"credit": 250.0, "equity": -0.2, "vol": 20.0},
    "EARNINGS": {"equity": -0.08, "vol": 6.0, "sectors": {"sector2": -0.15}},
    "MANAGEMENT_CHANGE": {"equity": -0.04},
    "PRODUCT_LAUNCH": {"equity": 0.03, "fx": {"EUR": 0.01}},
}
_SEVERITY, _HIT = {8: 0.6, 9: 0.8, 10: 1.0}, {0: "US", 1: "EUROPE", 2: "ASIA", 3: "LATAM", 4: "AFRICA"}


def _class_runs() -> dict[str, dict]:
    """A scenario for each class, severity and region: the class's moves times the severity's multiplier."""
    out = {}
    for name, moves in _CLASS_MOVES.items():
        for level, times in _SEVERITY.items():
            for region, hit in _HIT.items():
                scaled = {k: {x: y * times for x, y in v.items()} if isinstance(v, dict) else v * times for k, v in moves.items()}
                out[f"{name}/{level}/{region}"] = scaled | {"regions": [hit]}
    return out


@query(f"""WITH {SIGNALS}, fired AS (SELECT g.seq, s.event_class || '/' || CAST(least(10, g.impact) AS INTEGER) || '/' || s.region AS run FROM gated g JOIN scored s USING (seq) WHERE reason = 'pass'),
  {M.valued_sql(_class_runs()).replace('CROSS JOIN shocks s', 'CROSS JOIN (SELECT * FROM shocks WHERE run IN (SELECT run FROM fired)) s')}, total AS (SELECT run, sum(pnl) AS pnl, sum(d_el) AS d_el, sum(loan_fv) AS loan_fv FROM valued GROUP BY 1)
  SELECT seq, pnl, d_el, loan_fv FROM fired JOIN total USING (run)""")
def g16_stress_many(spark, d):
    name = F.concat_ws("/", "event_class", F.least(F.lit(10), F.col("impact")).cast("int").cast("string"), F.col("region").cast("string"))
    runs = M.scored(spark, d).select("seq", "event_class", "region")
    fired = portfolio.trigger_gates(_signals(spark, d)).where("reason = 'pass'").join(runs, "seq").select("seq", name.alias("name"))
    shocks = M.scenarios(spark, _class_runs()).withColumnRenamed("run", "name")
    return portfolio.stress_many(fired, shocks, ["name"], M.positions(spark, d), M.BBB_BP).select("seq", "pnl", "d_el", "loan_fv")


@query(f"WITH {M.VALUED} " + " UNION ALL ".join(f"SELECT run, '{c}' AS dimension, coalesce({c}, 'n/a') AS member, sum(impact) AS total FROM valued GROUP BY ALL" for c in ("asset_class", "sector", "rating", "region")))
def g17_impact_breakdowns(spark, d):
    return portfolio.breakdowns(_valued(spark, d), ["asset_class", "sector", "rating", "region"])


@query(f"WITH {M.VALUED} SELECT run, coalesce(sector, 'n/a') AS sector, " + ", ".join(f"coalesce(sum(CASE WHEN asset_class = '{c}' THEN impact END), 0) AS {c}" for c in ("bond", "derivative", "equity", "loan")) + " FROM valued GROUP BY 1, 2")
def g18_heatmap(spark, d):
    values = _valued(spark, d).withColumn("sector", F.coalesce("sector", F.lit("n/a")))
    return values.groupBy("run", "sector").pivot("asset_class", ["bond", "derivative", "equity", "loan"]).sum("impact").na.fill(0.0)


@query(f"WITH {M.VALUED} SELECT run, position, rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY impact, position) AS rank FROM valued) WHERE rank <= 10")
def g19_worst_positions(spark, d):
    return portfolio.worst_positions(_valued(spark, d)).select("run", "position", "rank")


_MULTIPLIER = "CASE run " + " ".join(f"WHEN '{run}' THEN {max(0.0, 1 + m['credit'] / M.BBB_BP)!r}::DOUBLE" for run, m in M.SCENARIOS.items()) + " END"


@query(f"""WITH {M.VALUED} SELECT run, sum(market_value) AS before, sum(market_value) + sum(pnl) AS after, sum(pnl) AS pnl, sum(pnl) / sum(market_value) AS pnl_share, sum(d_el) AS d_el, sum(impact) AS total, sum(impact) / sum(market_value) AS total_share,
    sum(loan_fv) AS loan_fv, {_MULTIPLIER} AS pd_multiplier FROM valued GROUP BY 1""")
def g20_stress_summary(spark, d):
    before, pnl, total = F.sum("market_value"), F.sum("pnl"), F.sum("impact")
    sums = _valued(spark, d).groupBy("run").agg(
        before.alias("before"), (before + pnl).alias("after"), pnl.alias("pnl"), (pnl / before).alias("pnl_share"), F.sum("d_el").alias("d_el"), total.alias("total"), (total / before).alias("total_share"), F.sum("loan_fv").alias("loan_fv")
    )
    multiplier = M.scenarios(spark).select("run", F.greatest(F.lit(0.0), 1 + F.col("credit") / M.BBB_BP).alias("pd_multiplier"))
    return sums.join(multiplier, "run")


@query(f"WITH {SIGNALS} SELECT reason, count(*) AS n FROM gated GROUP BY 1")
def g21_trigger_summary(spark, d):
    return portfolio.trigger_gates(_signals(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


# --- evaluation ---
_PRED = f"pred AS (SELECT l.doc_id, l.quality, l.toxic, CASE WHEN p > n THEN 1 ELSE 0 END AS predicted, p - n AS score FROM labels l JOIN (SELECT doc_id, {HITS(POSITIVE)} AS p, {HITS(NEGATIVE)} AS n FROM documents) USING (doc_id))"


def _predicted(spark, d):
    tokens = X.word_tokens(F.col("text"))
    hits = lambda words: F.size(F.filter(tokens, lambda t: t.isin(*words)))
    docs = M.documents(spark, d).select("doc_id", (hits(POSITIVE) - hits(NEGATIVE)).alias("score"))
    return table(spark, d, "labels").join(docs, "doc_id").withColumn("predicted", (F.col("score") > 0).cast("int"))


@query(f"""WITH {_PRED}, c AS (SELECT label, count_if(quality = label AND predicted = label) AS tp, count_if(quality <> label AND predicted = label) AS fp, count_if(quality = label AND predicted <> label) AS fn
    FROM pred, (VALUES (0), (1)) v(label) GROUP BY 1)
  SELECT CAST(label AS VARCHAR) AS label, tp, fp, fn, CASE WHEN tp + fn + fp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM c""")
def h1_classification_report(spark, d):
    rows = _predicted(spark, d).select(F.col("quality").cast("string").alias("g"), F.col("predicted").cast("string").alias("p"))
    return evaluation.classification_report(rows, "g", "p", ["0", "1"]).select("label", "tp", "fp", "fn", "f1")


@query(f"""WITH {_PRED} SELECT CAST(g AS VARCHAR) AS gold, CAST(p AS VARCHAR) AS predicted, (SELECT count(*) FROM pred WHERE quality = g AND predicted = p) AS n FROM (VALUES (0), (1), (2)) a(g), (VALUES (0), (1), (2)) b(p)""")
def h1_confusion_matrix(spark, d):
    rows = _predicted(spark, d).select(F.col("quality").cast("string").alias("g"), F.col("predicted").cast("string").alias("p"))
    return evaluation.confusion_matrix(rows, "g", "p", ["0", "1", "2"])


@query(f"""WITH {_PRED}, c AS (SELECT label, count_if(quality = label AND predicted = label) AS tp, count_if((quality = label) <> (predicted = label)) AS miss FROM pred, (VALUES (0), (1), (2)) v(label) GROUP BY 1)
  SELECT (SELECT count(*) FROM pred) AS n, (SELECT avg(CAST(coalesce(quality = predicted, false) AS INTEGER)) FROM pred) AS accuracy, (SELECT sum(CASE WHEN 2 * tp + miss > 0 THEN 2 * tp / (2 * tp + miss) ELSE 0.0::DOUBLE END) / 3 FROM c) AS macro_f1""")
def h1_overall(spark, d):
    rows = _predicted(spark, d).select(F.col("quality").cast("string").alias("g"), F.col("predicted").cast("string").alias("p"))
    return evaluation.overall(rows, "g", "p", ["0", "1", "2"])


@query(f"""WITH {M.MENTIONS}, e AS (SELECT k / 20 AS band, sentiment AS s, CASE WHEN sentiment > 0.3::DOUBLE THEN 1 WHEN sentiment < -0.3::DOUBLE THEN -1 ELSE 0 END AS g FROM mentions, (SELECT unnest(range(20)) AS k)),
  p AS (SELECT band, g, CASE WHEN s > band THEN 1 WHEN s < -band THEN -1 ELSE 0 END AS p FROM e), c AS (SELECT band, x, count_if(g = x AND p = x) AS t, count_if(g = x) + count_if(p = x) AS n FROM p, (VALUES (-1), (0), (1)) v(x) GROUP BY 1, 2)
  SELECT band, sum(CASE WHEN n > 0 THEN 2 * t / n ELSE 0.0 END) / 3 AS macro_f1 FROM c GROUP BY 1""")
def h2_tune_band(spark, d):
    rows = M.mentions(spark, d).withColumn("gold", X.sentiment_label(F.col("sentiment"), 0.3))
    return evaluation.tune_band(rows, "gold", "sentiment", [k / 20 for k in range(20)])


@query()
def h3_paired_bootstrap(spark, d):
    rows = _predicted(spark, d).select("doc_id", ((F.col("predicted") == F.col("quality")).cast("int") - F.col("toxic")).cast("double").alias("gap"))
    return evaluation.bootstrap(rows, "doc_id", "gap")


@query(f"""WITH {_PRED}, c AS (SELECT toxic, count_if(predicted = quality) AS k, count(*) AS n FROM pred GROUP BY 1)
  SELECT toxic, n, (k / n + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n) AS low,
    (k / n + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n) AS high FROM c""")
def h4_wilson_interval(spark, d):
    rows = _predicted(spark, d).groupBy("toxic").agg(F.count_if(F.col("predicted") == F.col("quality")).alias("k"), F.count("*").alias("n"))
    low, high = evaluation.wilson(F.col("k"), F.col("n"))
    return rows.select("toxic", "n", low.alias("low"), high.alias("high"))


_RANKS = "ranks AS (SELECT ticker, seq, rank() OVER (PARTITION BY ticker ORDER BY raw) + (count(*) OVER (PARTITION BY ticker, raw) - 1) / 2 AS a, rank() OVER (PARTITION BY ticker ORDER BY outlet) + (count(*) OVER (PARTITION BY ticker, outlet) - 1) / 2 AS b FROM scored)"


@query(f"WITH {M.SCORED}, {_RANKS} SELECT ticker, corr(a, b) AS spearman, count(*) AS n FROM ranks GROUP BY 1")
def h5_spearman(spark, d):
    return evaluation.spearman(M.scored(spark, d), "ticker", "raw", "outlet")


@query(f"""WITH {M.SCORED}, r AS (SELECT ticker, outlet, row_number() OVER (PARTITION BY ticker ORDER BY raw, seq) AS r, count(*) OVER (PARTITION BY ticker) AS n FROM scored)
  SELECT ticker, CAST(greatest(0, ceil((r - 1) * 10 / greatest(n - 1, 1)) - 1) AS INTEGER) AS decile, count(*) AS n, avg(outlet) AS mean_target FROM r GROUP BY 1, 2""")
def h6_decile_means(spark, d):
    return evaluation.decile_means(M.scored(spark, d), "ticker", "raw", "outlet", "seq")


@query(f"""WITH {M.SCORED}, c AS (SELECT ticker, quantile_cont(raw, 0.9) AS s, quantile_cont(CAST(outlet AS DOUBLE), 0.9) AS g FROM scored GROUP BY 1)
  SELECT ticker, count(*) AS n, avg(CAST(outlet >= g AS INTEGER)) AS hit_rate FROM scored JOIN c USING (ticker) WHERE raw >= s GROUP BY 1""")
def h7_top_decile_hit(spark, d):
    return evaluation.top_decile_hit(M.scored(spark, d), "ticker", "raw", "outlet")


_DAYS = f"""WITH {M.SCORED}, d AS (SELECT (t - {M.START}) // 86400000000 AS n, max(severity) AS s, avg(sentiment) AS a FROM scored GROUP BY 1), tr AS (SELECT n FROM d WHERE s >= 6), ev AS (SELECT n FROM d WHERE a < -0.01::DOUBLE)"""


@query(_DAYS + """, h AS (SELECT tr.n, ev.n AS e FROM tr JOIN ev ON ev.n BETWEEN tr.n AND tr.n + 2)
  SELECT (SELECT count(DISTINCT n) FROM h) AS hit_triggers, (SELECT count(DISTINCT e) FROM h) AS hit_events, (SELECT count(*) FROM tr) AS triggers, (SELECT count(*) FROM ev) AS events""")
def h10_lagged_precision_recall(spark, d):
    days = M.scored(spark, d).groupBy(F.floor((F.col("t") - M.START) / 86_400_000_000).alias("n")).agg(F.max("severity").alias("s"), F.avg("sentiment").alias("a"))
    out = evaluation.lagged_precision_recall(days.where("s >= 6"), days.where("a < -0.01"), 2)
    return out.select("hit_triggers", "hit_events", "triggers", "events")


@query(f"WITH {FEED} SELECT source, strftime(make_timestamp(t), '%Y-%m') AS month, count(*) AS n FROM feed GROUP BY 1, 2")
def h13_feed_stats(spark, d):
    return M.feed(spark, d).groupBy("source", F.date_format(F.timestamp_micros("t"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5(doc_id || ':0'), doc_id) AS n FROM documents) WHERE n <= CASE WHEN lang = 'en' THEN 4 ELSE 2 END""")
def h16_stratified_sample(spark, d):
    quota = F.when(F.col("lang") == "en", 4).otherwise(2)
    return evaluation.stratified_sample(M.documents(spark, d), ["source", "lang"], "doc_id", quota).select("doc_id")


@query(f"""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders), b AS (SELECT o_orderkey AS k, o_totalprice + CASE WHEN o_orderkey % 100 = 0 THEN 1 ELSE 0 END AS v FROM orders WHERE o_orderkey % 50 <> 1)
  SELECT 'v' AS "column", count_if(b.k IS NULL) AS only_a, count_if(a.k IS NULL) AS only_b, count_if(abs(a.v - b.v) > 0.5) AS differing, max(abs(CAST(a.v AS DOUBLE) - CAST(b.v AS DOUBLE))) AS largest FROM a FULL JOIN b ON a.k = b.k""")
def h19_compare_tables(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = a.where("k % 50 <> 1").withColumn("v", F.col("v") + F.when(F.col("k") % 100 == 0, 1).otherwise(0))
    return evaluation.compare_tables(a, b, "k", ["v"], 0.5)
