"""Registered queries: episodes of stress, what was fired for them, and what the market and the book then did."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrisk.operators import episodes, portfolio
from quillrisk.plans import models as M
from quillrisk.plans.queries import query
from quillrisk.plans.risk_queries import SIGNALS, _class_runs, _signals, cooldown_sql
from quillrisk.session import durable

DAY = 86_400_000_000
#: A class's day is bad below this mean sentiment; the stream's days lie this many days after the prices'; weeks that a move is measured over.
BAD, SHIFT, HORIZON = -0.23, 9499, 2


def _series(spark, d):
    """The market as ``equity``, the symbols as sectors by their first digit."""
    prices = M.prices(spark, d)
    index = prices.groupBy("session").agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("value")).select(F.lit("equity").alias("factor"), "session", "value")
    named = F.concat(F.lit("sector"), F.substring("symbol", 1, 1))
    return index.union(prices.select(named, "session", "close"))


def _matched(spark, d):
    signals = portfolio.trigger_gates(_signals(spark, d)).where("reason = 'pass'")
    fired = portfolio.cooldown(signals, "ticker").where("decision <> 'cooldown'").select("seq", "impact")
    known = M.scored(spark, d).where(F.col("event_class") != "OTHER").select("seq", "t", "ticker", "event_class", "region", (F.col("outlet") % 4).alias("outlets"))
    name = F.concat_ws("/", "event_class", F.least(F.lit(10), F.col("impact")).cast("int").cast("string"), F.col("region").cast("string"))
    runs = fired.join(known, "seq").withColumn("scenario", name)
    bad = M.scored(spark, d).groupBy("ticker", F.floor(F.col("t") / DAY).alias("day")).agg(F.avg("sentiment").alias("mean")).where(F.col("mean") < BAD)
    return episodes.match_runs(episodes.episodes(bad, "ticker"), runs, "ticker")


def _realised(spark, d, matched):
    date = F.date_from_unix_date((F.col("day") - SHIFT).cast("int"))
    return episodes.realised_moves(matched, _series(spark, d), date, HORIZON)


def _predicted(spark):
    rows = [(run, f, float(v)) for run, m in _class_runs().items() for f, v in [("equity", m.get("equity", 0.0)), *m.get("sectors", {}).items()]]
    return spark.createDataFrame(rows, "scenario string, factor string, predicted double")  # a row a class, severity, region and factor


_MATCHED = f"""{SIGNALS}, {cooldown_sql("SELECT * FROM gated WHERE reason = 'pass'")},
  runs AS (SELECT f.ticker, s.t // {DAY} AS day, s.t, f.seq, f.impact, s.outlet % 4 AS outlets, s.event_class || '/' || CAST(least(10, f.impact) AS INTEGER) || '/' || s.region AS scenario FROM f JOIN scored s USING (seq) WHERE decision <> 'cooldown' AND event_class <> 'OTHER'),
  bad AS (SELECT ticker, t // {DAY} AS day FROM scored GROUP BY 1, 2 HAVING avg(sentiment) < {BAD}::DOUBLE),
  episodes AS (SELECT ticker, min(day) AS day, max(day) AS last_day FROM (SELECT *, day - row_number() OVER (PARTITION BY ticker ORDER BY day) AS g FROM bad) GROUP BY ticker, g),
  same AS (SELECT ticker, day, first(seq ORDER BY impact DESC, outlets DESC, t, seq) AS seq, first(scenario ORDER BY impact DESC, outlets DESC, t, seq) AS scenario FROM episodes JOIN runs USING (ticker, day) GROUP BY 1, 2),
  prior AS (SELECT e.ticker, e.day, count(*) AS n, first(seq ORDER BY t DESC, seq) AS seq, first(scenario ORDER BY t DESC, seq) AS scenario FROM episodes e JOIN runs r ON r.ticker = e.ticker AND r.day BETWEEN e.day - 7 AND e.day - 1 GROUP BY 1, 2),
  matched AS (SELECT ticker, day, last_day, CASE WHEN same.seq IS NOT NULL THEN 'fired' WHEN prior.seq IS NOT NULL THEN 'missed, earlier run' ELSE 'missed' END AS status, coalesce(same.seq, prior.seq) AS seq, coalesce(same.scenario, prior.scenario) AS scenario,
    coalesce(n, 0) AS prior_runs FROM episodes LEFT JOIN same USING (ticker, day) LEFT JOIN prior USING (ticker, day))"""
_REALISED = f"""{M.PRICES}, series AS (SELECT 'equity' AS factor, session, sum(close * volume) / sum(volume) AS value FROM prices GROUP BY 2 UNION ALL SELECT 'sector' || substr(symbol, 1, 1), session, close FROM prices),
  sess AS (SELECT session, row_number() OVER (ORDER BY session) AS n FROM (SELECT DISTINCT session FROM prices)),
  places AS (SELECT day, (SELECT count(*) FROM sess WHERE session < DATE '1970-01-01' + CAST(d.day - {SHIFT} AS INTEGER)) AS k FROM (SELECT DISTINCT day FROM matched) d),
  win AS (SELECT day, a.session AS s, b.session AS e FROM places JOIN sess a ON a.n = k JOIN sess b ON b.n = k + {HORIZON}),
  real AS (SELECT day, factor, max_by(value, session) FILTER (session <= e) / max_by(value, session) FILTER (session <= s) - 1 AS realised FROM win, series GROUP BY 1, 2 HAVING realised IS NOT NULL)"""


@query(f"WITH RECURSIVE {_MATCHED} SELECT * FROM matched")
def h12_episodes(spark, d):
    return _matched(spark, d)


_RUN_VALUES = ", ".join(f"('{run}', '{f}', {v!r}::DOUBLE)" for run, m in _class_runs().items() for f, v in [("equity", m.get("equity", 0.0)), *m.get("sectors", {}).items()])


@query(f"""WITH RECURSIVE {_MATCHED}, {_REALISED}, predicted(scenario, factor, predicted) AS (VALUES {_RUN_VALUES})
  SELECT ticker, day, status, factor, predicted, realised, predicted - realised AS error, sign(predicted) = sign(realised) AS same_sign FROM matched JOIN predicted USING (scenario) JOIN real USING (day, factor)""")
def h12_episode_factors(spark, d):
    matched = durable(_matched(spark, d), "episodes")
    return episodes.compare(matched, "ticker", _predicted(spark), _realised(spark, d, matched))


_RUNS = M.shock_rows(_class_runs())
_VALUED = M.valued_sql(_class_runs()).replace(_RUNS, _RUNS.replace("shocks(run", "class_shocks(run").replace("sector_moves(run, sector, sector_move) AS (", "sector_moves(run, sector, sector_move) AS (SELECT 'day/' || day, factor, realised FROM real WHERE factor <> 'equity' UNION ALL ")
    + f""", shocks AS (SELECT * FROM class_shocks WHERE run IN (SELECT scenario FROM matched) UNION ALL SELECT 'day/' || day, {', '.join('realised' if f == 'equity' else '0.0::DOUBLE' for f in M.FACTORS)} FROM real WHERE factor = 'equity')""")


@query(f"""WITH RECURSIVE {_MATCHED}, {_REALISED}, {_VALUED}, total AS (SELECT run, sum(pnl) AS pnl, sum(d_el) AS d_el FROM valued GROUP BY 1)
  SELECT ticker, day, status, p.pnl AS pnl_predicted, r.pnl AS pnl_realised, p.d_el AS d_el_predicted, r.d_el AS d_el_realised FROM matched m JOIN total p ON p.run = m.scenario JOIN total r ON r.run = 'day/' || m.day""")
def h12_episode_book(spark, d):
    """The whole book under the shocks that were fired and under the moves that came; a scenario or a day is priced once."""
    matched = durable(_matched(spark, d).where("scenario IS NOT NULL"), "episodes")
    moves = _realised(spark, d, matched)
    day = F.concat(F.lit("day/"), F.col("day").cast("string"))
    sectors = F.map_from_entries(F.collect_list(F.when(F.col("factor") != "equity", F.struct("factor", "realised"))))  # a handful of factors a day
    came = moves.groupBy(day.alias("name")).agg(F.max(F.when(F.col("factor") == "equity", F.col("realised"))).alias("equity"), sectors.alias("sectors"))
    shocks = M.scenarios(spark, _class_runs()).withColumnRenamed("run", "name").unionByName(came.where("equity IS NOT NULL"), allowMissingColumns=True)
    sides = F.explode(F.array(F.struct(F.lit("predicted").alias("side"), F.col("scenario").alias("name")), F.struct(F.lit("realised").alias("side"), day.alias("name")))).alias("s")
    wanted = matched.select("ticker", "day", "status", sides).select("ticker", "day", "status", "s.*")
    totals = portfolio.stress_many(wanted, shocks, ["name"], M.positions(spark, d), M.BBB_BP)
    side = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}")
    out = totals.groupBy("ticker", "day", "status").agg(*[side(c, s) for c in ("pnl", "d_el") for s in ("predicted", "realised")])
    return out.where("pnl_predicted IS NOT NULL AND pnl_realised IS NOT NULL")
