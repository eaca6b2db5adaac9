"""Registered queries: factor moves over windows, calibration before a cutoff, scenarios of signals and their combinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrisk.operators import scenarios
from quillrisk.plans import models as M
from quillrisk.plans.queries import query

DAY = 86_400_000_000
CUTOFF = "1997-12-31"
#: Factors over the prices: the market, two symbols, one that is not listed and so moves with the market, a difference in other units, an inverse.
_FACTORS = [
    ("equity", "market", "return", 1.0, None),
    ("urgent", "1-URGENT", "return", 1.0, "market"),
    ("unlisted", "6-NONE", "return", 1.0, "market"),
    ("rate", "2-HIGH", "difference", 100.0, None),
    ("currency", "4-NOT SPECIFIED", "inverse", 1.0, None),
    ("missing", "7-NONE", "return", 1.0, None),
]
_FACTOR_ROWS = ", ".join(f"('{f}', '{s}', '{k}', {x}::DOUBLE, {repr(p) if p else 'NULL'})" for f, s, k, x, p in _FACTORS)
_WINDOWS = "windows AS (SELECT CAST(year(session) AS VARCHAR) AS name, min(session) + 5 AS start, max(session) + 2 AS end FROM prices GROUP BY year(session))"
_SERIES = "series AS (SELECT 'market' AS symbol, session, sum(close * volume) / sum(volume) AS value FROM prices GROUP BY 2 UNION ALL SELECT symbol, session, close FROM prices)"
_MEASURED = f"""{M.PRICES}, {_WINDOWS}, {_SERIES}, factors(factor, symbol, kind, scale, proxy) AS (VALUES {_FACTOR_ROWS}),
  ends AS (SELECT name, symbol, max_by(value, session) FILTER (session <= w.start) AS x, max_by(value, session) FILTER (session <= w.end) AS y FROM windows w, series GROUP BY 1, 2),
  measured AS (SELECT w.name, f.factor, coalesce(CASE kind WHEN 'return' THEN o.y / o.x - 1 WHEN 'difference' THEN (o.y - o.x) * scale ELSE 1 / (o.y / o.x) - 1 END, p.y / p.x - 1) AS move
    FROM windows w CROSS JOIN factors f LEFT JOIN ends o ON o.name = w.name AND o.symbol = f.symbol LEFT JOIN ends p ON p.name = w.name AND p.symbol = f.proxy)"""


def _windows(spark, d):
    years = M.prices(spark, d).groupBy(F.year("session").cast("string").alias("name"))
    return years.agg(F.date_add(F.min("session"), 5).alias("start"), F.date_add(F.max("session"), 2).alias("end"))


def _measured(spark, d, windows):
    prices = M.prices(spark, d)
    index = prices.groupBy("session").agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("value")).select(F.lit("market").alias("symbol"), "session", "value")
    factors = spark.createDataFrame(_FACTORS, "factor string, symbol string, kind string, scale double, proxy string")
    return scenarios.measure_windows(windows, index.union(prices.select("symbol", "session", "close")), factors)


@query(f"WITH {_MEASURED} SELECT name, factor, move FROM measured")
def f5_factor_moves(spark, d):
    return _measured(spark, d, _windows(spark, d))


_CALIBRATED = f"{_MEASURED}, calibration AS (SELECT name AS analogue, factor, move AS value FROM measured JOIN windows USING (name) WHERE windows.end <= DATE '{CUTOFF}')"


def _calibration(spark, d):
    early = scenarios.before_cutoff(_windows(spark, d), CUTOFF, late="drop")
    return _measured(spark, d, early).select(F.col("name").alias("analogue"), "factor", F.col("move").alias("value"))


@query(f"WITH {_CALIBRATED} SELECT analogue, factor, value FROM calibration")
def g6_calibration_by_cutoff(spark, d):
    return _calibration(spark, d)


#: Which years stand for a class, by rule; a class that is absent has no market-wide scenario.
_MAPPING = {
    "CREDIT_EVENT": {"default": ["1992", "1994"], "severe": ["1996", "1997"]},
    "EARNINGS": {"default": ["1993"], "hawkish": ["1995", "1992"], "growth": ["1996"]},
    "MANAGEMENT_CHANGE": {"hawkish": ["1994"], "default": ["1993", "1995"]},
}
_MAPPING_ROWS = [(c, rule, a, k) for c, rules in _MAPPING.items() for rule, names in rules.items() for k, a in enumerate(names)]
_TIMES = {8: 0.6, 9: 0.8, 10: 1.0}
_SUB = "CASE seq % 4 WHEN 0 THEN 'hawkish' WHEN 1 THEN 'growth' ELSE 'default' END"
_BUILT = f"""{M.SCORED}, {_CALIBRATED}, mapping(event_class, rule, analogue, place) AS (VALUES {', '.join(f"('{c}', '{r}', '{a}', {k})" for c, r, a, k in _MAPPING_ROWS)}),
  signals AS (SELECT seq AS id, event_class, severity + 4 AS impact, {_SUB} AS sub FROM scored),
  ruled AS (SELECT *, CASE WHEN impact >= 10 AND EXISTS (FROM mapping m WHERE m.event_class = s.event_class AND rule = 'severe') THEN 'severe' WHEN EXISTS (FROM mapping m WHERE m.event_class = s.event_class AND rule = sub) THEN sub ELSE 'default' END AS rule FROM signals s),
  chosen AS (SELECT event_class, rule, factor, first(value ORDER BY abs(value) DESC, place) AS value, first(analogue ORDER BY abs(value) DESC, place) AS driver FROM mapping JOIN calibration USING (analogue) WHERE value IS NOT NULL GROUP BY 1, 2, 3),
  built AS (SELECT id, event_class || ':' || rule AS scenario, CASE WHEN impact < 8 THEN 0.0::DOUBLE WHEN impact = 8 THEN 0.6::DOUBLE WHEN impact = 9 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS severity, factor, value, driver FROM ruled JOIN chosen USING (event_class, rule))"""


def _built(spark, d):
    sub = F.when(F.col("seq") % 4 == 0, "hawkish").when(F.col("seq") % 4 == 1, "growth").otherwise("default")
    signals = M.scored(spark, d).select(F.col("seq").alias("id"), "event_class", (F.col("severity") + 4).alias("impact"), sub.alias("sub"))
    mapping = spark.createDataFrame(_MAPPING_ROWS, "event_class string, rule string, analogue string, place int")
    return scenarios.build_scenarios(signals, mapping, _calibration(spark, d), _TIMES), mapping


@query(f"WITH {_BUILT} SELECT id, scenario, severity, factor, value * severity AS value, driver FROM built")
def g7_signal_scenarios(spark, d):
    return _built(spark, d)[0]


@query(f"""WITH {_BUILT}, timed AS (SELECT b.*, b.value * b.severity AS shock, t // {DAY} AS day FROM built b JOIN scored s ON s.seq = b.id),
  f AS (SELECT day, factor, first(shock ORDER BY abs(shock) DESC, id) AS value, first(scenario || '/' || driver ORDER BY abs(shock) DESC, id) AS named, first(driver ORDER BY abs(shock) DESC, id) AS driver FROM timed GROUP BY 1, 2),
  n AS (SELECT day, scenario, min(id) AS place, max(severity) AS severity FROM timed GROUP BY 1, 2), w AS (SELECT day, string_agg(scenario, '+' ORDER BY place, scenario) AS scenario, max(severity) AS severity, count(*) AS k FROM n GROUP BY 1),
  a AS (SELECT day, string_agg(DISTINCT analogue, ',' ORDER BY analogue) AS analogues FROM n JOIN mapping m ON n.scenario = m.event_class || ':' || m.rule GROUP BY 1)
  SELECT day, scenario, severity, analogues, factor, value, CASE WHEN k = 1 THEN driver ELSE named END AS driver FROM f JOIN w USING (day) JOIN a USING (day)""")
def g10_scenario_union(spark, d):
    """The scenarios of a day's signals as one."""
    built, mapping = _built(spark, d)
    names = mapping.groupBy(F.concat_ws(":", "event_class", "rule").alias("scenario")).agg(F.collect_set("analogue").alias("analogues"))
    days = M.scored(spark, d).select(F.col("seq").alias("id"), F.floor(F.col("t") / DAY).alias("day"))
    rows = built.join(days, "id").join(names, "scenario").withColumnRenamed("id", "place")
    return scenarios.combine_scenarios(rows, ["day"]).withColumn("analogues", F.array_join("analogues", ","))


_MACRO = {"0": "Americas", "1": "Americas", "2": "Europe", "3": "Europe"}


@query(f"""WITH {M.MENTIONS}, s AS (SELECT story, t // {DAY} AS day, event_class, list_distinct(list(CASE WHEN (region + seq % 2) < 2 THEN 'Americas' WHEN (region + seq % 2) < 4 THEN 'Europe' ELSE 'Global' END)) AS m FROM mentions GROUP BY 1, 2, 3)
  SELECT story, day, event_class, event_class || '|' || CASE WHEN len(m) = 1 THEN m[1] ELSE 'Global' END AS key FROM s""")
def g12_macro_key(spark, d):
    """The key of a story's signal of a day, from all regions of its mentions."""
    region = (F.col("region") + F.col("seq") % 2).cast("string")
    signals = M.mentions(spark, d).groupBy("story", F.floor(F.col("t") / DAY).alias("day"), "event_class").agg(F.collect_set(region).alias("regions"))
    return signals.select("story", "day", "event_class", scenarios.trigger_key(F.col("event_class"), F.col("regions"), _MACRO).alias("key"))
