"""Episodes of stress, the runs that were fired for them, and what the market then did.

Days are whole numbers since 1970. An episode is a class and the days from its first to its last bad one; a run is a stress test that a trigger fired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrisk.operators.market import asof_values

LOOK_BACK = 7


def episodes(bad_days: DataFrame, key: str, gap: int = 1) -> DataFrame:
    """``(key, day, last_day)``: runs of bad days in which no two neighbours are more than ``gap`` days apart.

    ``bad_days``: ``key, day``; repeated days count once, null days not at all. A key has a row a day at most, so its days fit into a window.
    """
    days = bad_days.select(key, "day").where("day IS NOT NULL").distinct()
    over = Window.partitionBy(key).orderBy("day")
    starts = F.coalesce((F.col("day") - F.lag("day").over(over) > gap).cast("int"), F.lit(1))
    islands = days.withColumn("_start", starts).withColumn("_island", F.sum("_start").over(over))
    return islands.groupBy(key, "_island").agg(F.min("day").alias("day"), F.max("day").alias("last_day")).drop("_island")


def match_runs(found: DataFrame, runs: DataFrame, key: str, look_back: int = LOOK_BACK) -> DataFrame:
    """``found`` with ``status, seq, scenario, prior_runs``.

    ``runs``: ``key, t`` (microseconds), ``seq, impact, outlets, scenario``. A run of the class on the episode's first day makes it ``fired``: the one with the highest
    impact, then most outlets, then the first. Else it is ``missed``, and the latest run of the ``look_back`` days before is given as context, if there is one
    (``missed, earlier run``). ``prior_runs`` counts the runs of those days either way. Runs are a row a key and day before they are joined, by cells as
    long as the look-back, so that the join is on equal keys.
    """
    day = F.floor(F.col("t") / 86_400_000_000)
    run = F.struct("seq", "scenario")
    best = F.min_by(run, F.struct((-F.col("impact")).alias("i"), (-F.col("outlets")).alias("o"), "t", "seq"))
    latest = F.min_by(run, F.struct((-F.col("t")).alias("t"), "seq"))
    days = runs.groupBy(F.col(key).alias("_key"), day.alias("_run_day")).agg(best.alias("_best"), latest.alias("_latest"), F.count("*").alias("_n"))
    days = days.withColumn("_cell", F.floor(F.col("_run_day") / look_back))
    cell = F.floor(F.col("day") / look_back)
    near = found.select(F.col(key).alias("_key"), "day", F.explode(F.array(cell - 1, cell)).alias("_cell")).join(days, ["_key", "_cell"])
    near = near.where((F.col("_run_day") <= F.col("day")) & (F.col("_run_day") >= F.col("day") - look_back))
    same = F.col("_run_day") == F.col("day")
    facts = near.groupBy("_key", F.col("day").alias("_day")).agg(
        F.max(F.when(same, F.col("_best"))).alias("_same"),  # one row at most
        F.max_by("_latest", F.when(~same, F.col("_run_day"))).alias("_prior"),
        F.coalesce(F.sum(F.when(~same, F.col("_n"))), F.lit(0)).alias("prior_runs"),
    )
    out = found.join(facts, (F.col(key) == F.col("_key")) & (F.col("day") == F.col("_day")), "left")
    prior = F.when(F.col("prior_runs") > 0, F.col("_prior"))
    status = F.when(F.col("_same").isNotNull(), "fired").when(prior.isNotNull(), "missed, earlier run").otherwise("missed")
    chosen = F.coalesce("_same", prior)
    return out.select(*found.columns, status.alias("status"), chosen["seq"].alias("seq"), chosen["scenario"].alias("scenario"), F.coalesce("prior_runs", F.lit(0)).alias("prior_runs"))


def realised_moves(days: DataFrame, series: DataFrame, date: Column, horizon: int) -> DataFrame:
    """``(day, factor, realised)``: moves from the last session before a day to the ``horizon``-th session after that one.

    ``series``: ``factor, session, value``; ``date``: the session date of a ``day``. Days before the second session, or whose window ends after the last one, have no
    moves, nor have factors without a value on or before the window's start. Days and sessions are a row a date.
    """
    sessions = series.select("session").distinct()
    sessions = sessions.withColumn("n", F.row_number().over(Window.orderBy("session")))  # the calendar alone
    points = days.select("day").distinct().select("day", F.lit("all").alias("symbol"), F.date_sub(date, 1).alias("t"))
    numbered = asof_values(points, sessions.select(F.lit("all").alias("symbol"), F.col("session").alias("t"), F.col("n").alias("value")))
    windows = numbered.select("day", "value").join(sessions.select(F.col("n").alias("value"), F.col("session").alias("start")), "value")
    windows = windows.withColumn("_end", F.col("value") + horizon).join(sessions.select(F.col("n").alias("_end"), F.col("session").alias("end")), "_end")
    ends = F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col("start").alias("t")), F.struct(F.lit("y").alias("side"), F.col("end").alias("t")))).alias("p")
    factors = series.select(F.col("factor").alias("symbol")).distinct()
    wanted = windows.select("day", ends).select("day", "p.side", "p.t").crossJoin(factors)  # a row a window and factor: the result
    values = asof_values(wanted, series.select(F.col("factor").alias("symbol"), F.col("session").alias("t"), "value"))
    found = values.groupBy("day", F.col("symbol").alias("factor")).agg(F.max(F.when(F.col("side") == "x", F.col("value"))).alias("x"), F.max(F.when(F.col("side") == "y", F.col("value"))).alias("y"))
    return found.select("day", "factor", (F.try_divide("y", "x") - 1).alias("realised")).where("realised IS NOT NULL")


def compare(matched: DataFrame, key: str, shocks: DataFrame, realised: DataFrame) -> DataFrame:
    """``(key, day, status, factor, predicted, realised, error, same_sign)`` over the factors that both sides have.

    ``shocks``: ``scenario, factor, predicted``. Two zeros have the same sign. Episodes without a run have no rows.
    """
    rows = matched.where("scenario IS NOT NULL").select(key, "day", "status", "scenario").join(shocks, "scenario").join(realised, ["day", "factor"])
    same = F.signum("predicted") == F.signum("realised")
    return rows.select(key, "day", "status", "factor", "predicted", "realised", (F.col("predicted") - F.col("realised")).alias("error"), same.alias("same_sign"))
