"""Market series: event studies, information coefficients, performance, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def close_times(sessions: DataFrame) -> DataFrame:
    """``(session, close)``: 16:00 New York in UTC, whatever the season."""
    local = F.make_timestamp(F.year("session"), F.month("session"), F.dayofmonth("session"), F.lit(16), F.lit(0), F.lit(0))
    return sessions.select("session", F.to_utc_timestamp(local, "America/New_York").alias("close"))


def returns(prices: DataFrame, symbol: str = "symbol", time: str = "session", value: str = "close") -> DataFrame:
    """Add ``ret`` against the symbol's row before, and ``n``, the row's place."""
    order = Window.partitionBy(symbol).orderBy(time)
    return prices.withColumn("ret", F.col(value) / F.lag(value).over(order) - 1).withColumn("n", F.row_number().over(order))


def asof_values(points: DataFrame, series: DataFrame, key: str = "symbol", time: str = "t", value: str = "value", days: int = 366) -> DataFrame:
    """``points`` (``key, time``) with the last non-null value of the series on or before each; null where the series starts later.

    One union and windows over blocks of ``days`` of a key; what a block begins with is carried over from a row a block, so that no key's whole
    series meets in a task. ``time`` is a date; extra columns of the points are kept.
    """
    both = points.withColumn(value, F.lit(None).cast(series.schema[value].dataType)).withColumn("_kind", F.lit(1))
    both = both.unionByName(series.select(key, time, value).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("_block", F.floor(F.unix_date(time) / days))
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(time)))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(key, "_block").agg(last.alias("_last")).withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    over = Window.partitionBy(key, "_block").orderBy(time, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(value, F.last(value, ignorenulls=True).over(over)).where("_kind = 1").join(carried, [key, "_block"])
    return found.withColumn(value, F.coalesce(value, "_carried")).drop("_kind", "_block", "_carried")


def event_study(rows: DataFrame, symbol: str = "symbol", first: int = -120, last: int = -21, least: int = 60) -> DataFrame:
    """Add ``car``: abnormal return over a row and the next, by a market model over the rows ``first`` to ``last`` around it.

    ``rows``: ``ret, market`` and ``n``, dense per symbol.
    """
    order = Window.partitionBy(symbol).orderBy("n")
    before = order.rowsBetween(first, last)
    pair = F.col("ret").isNotNull() & F.col("market").isNotNull()
    y, x = F.when(pair, F.col("ret")), F.when(pair, F.col("market"))
    out = rows.withColumns({"slope": F.regr_slope(y, x).over(before), "base": F.regr_intercept(y, x).over(before), "used": F.count(y).over(before)})
    abnormal = lambda c, m: c - (F.col("base") + F.col("slope") * m)
    nxt = abnormal(F.lead("ret").over(order), F.lead("market").over(order))
    return out.withColumn("car", F.when(F.col("used") >= least, abnormal(F.col("ret"), F.col("market")) + nxt))


def abnormal_volume(rows: DataFrame, symbol: str = "symbol", volume: str = "volume", first: int = -30, last: int = -6) -> DataFrame:
    """Add ``abnormal_volume``: ln of the volume over its mean in the rows ``first`` to ``last`` around it; null where either is missing or not above 0."""
    usual = F.avg(volume).over(Window.partitionBy(symbol).orderBy("n").rowsBetween(first, last))
    out = rows.withColumn("_usual", usual)
    good = (F.col(volume) > 0) & (F.col("_usual") > 0)
    return out.withColumn("abnormal_volume", F.when(good, F.ln(F.col(volume) / F.col("_usual")))).drop("_usual")


def average_rank(value: str, *by: str) -> Column:
    """Ranks within ``by``, the mean of their places for equal values."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def correlation(a: str, b: str) -> Column:
    """Pearson correlation; null where a column does not vary (the built-in one fails there in ANSI mode)."""
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def daily_spearman(rows: DataFrame, day: str, a: str, b: str, least: int = 5) -> DataFrame:
    """``(day, ic, names)``: rank correlation of two columns within each day that has ``least`` rows."""
    ranked = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"_ra": average_rank(a, day), "_rb": average_rank(b, day)})
    return ranked.groupBy(day).agg(correlation("_ra", "_rb").alias("ic"), F.count("*").alias("names")).where(F.col("names") >= least)


def information_coefficient(daily: DataFrame) -> DataFrame:
    """Mean, deviation, t statistic and share of positive days."""
    good = daily.where(F.col("ic").isNotNull() & ~F.isnan("ic"))
    mean, std, n = F.avg("ic"), F.stddev_samp("ic"), F.count("*")
    return good.agg(n.alias("days"), mean.alias("mean_ic"), std.alias("std_ic"), (mean / (std / F.sqrt(n))).alias("t_stat"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("positive"))


def performance(rows: DataFrame, series: str, ret: str, year: int = 252) -> DataFrame:
    """Per series: total, annualised and volatility of returns, their ratio, and the deepest fall from a peak."""
    path = Window.partitionBy(series).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    wealth = rows.withColumn("_w", F.exp(F.sum(F.log1p(ret)).over(path)))
    wealth = wealth.withColumn("_fall", F.col("_w") / F.max("_w").over(path) - 1)
    total, n = F.exp(F.sum(F.log1p(ret))) - 1, F.count("*")
    vol = F.stddev_samp(ret) * F.sqrt(F.lit(float(year)))
    return wealth.groupBy(series).agg(
        total.alias("total"),
        (F.exp(F.sum(F.log1p(ret)) * year / n) - 1).alias("annual"),
        vol.alias("volatility"),
        (F.avg(ret) * year / vol).alias("sharpe"),
        F.min("_fall").alias("drawdown"),
    )


def rolling_mean(rows: DataFrame, series: str, value: str, n: int = 20) -> DataFrame:
    """Add ``rolling``: the mean of the last ``n`` values by ``n``, null until there are as many."""
    over = Window.partitionBy(series).orderBy("n").rowsBetween(1 - n, 0)
    return rows.withColumn("rolling", F.when(F.count(value).over(over) == n, F.avg(value).over(over)))


def beta_and_vol(rows: DataFrame, symbol: str, ret: str, market: str, last: int = 252, year: int = 252) -> DataFrame:
    """Per symbol over its last rows: annualised volatility and beta to the market."""
    recent = rows.where(F.col(ret).isNotNull() & F.col(market).isNotNull())
    recent = recent.withColumn("_n", F.row_number().over(Window.partitionBy(symbol).orderBy(F.desc("n")))).where(F.col("_n") <= last)
    return recent.groupBy(symbol).agg(
        (F.stddev_samp(ret) * F.sqrt(F.lit(float(year)))).alias("volatility"), F.try_divide(F.covar_samp(ret, market), F.var_samp(market)).alias("beta")
    )


def tilt_weights(rows: DataFrame, day: str, base: str, level: str, confidence: str, kappa: float, deadband: float) -> DataFrame:
    """Add ``weight``: base weights tilted by ``exp(kappa * s * c)``, summing to one each day; no tilt inside the deadband."""
    s = F.when(F.abs(level) < deadband, 0.0).otherwise(F.col(level))
    out = rows.withColumn("_w", F.col(base) * F.exp(kappa * s * F.col(confidence)))
    return out.withColumn("weight", F.col("_w") / F.sum("_w").over(Window.partitionBy(day))).drop("_w")


def cap_weights(rows: DataFrame, day: str, weight: str, low: float, high: float, steps: int = 60) -> DataFrame:
    """Add ``capped``: ``clip(scale * w, low, high)`` with the scale at which each day sums to one.

    The sum rises with the scale, so a fold of halvings over the day's weight array finds it. Null where the bounds are infeasible.
    """
    days = rows.groupBy(day).agg(F.collect_list(weight).alias("_all"))
    total = lambda scale: F.aggregate("_all", F.lit(0.0), lambda s, w: s + F.greatest(F.lit(low), F.least(F.lit(high), w * scale)))
    top = F.lit(high) / F.array_min("_all") + 1
    start = F.struct(F.lit(0.0).alias("lo"), top.alias("hi"))

    def halve(state: Column, _: Column) -> Column:
        middle = (state["lo"] + state["hi"]) / 2
        above = total(middle) >= 1
        return F.struct(F.when(above, state["lo"]).otherwise(middle).alias("lo"), F.when(above, middle).otherwise(state["hi"]).alias("hi"))

    n = F.size("_all")
    scale = F.when((n * low <= 1) & (n * high >= 1), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["hi"])
    days = days.select(day, scale.alias("_scale"))
    return rows.join(days, day).withColumn("capped", F.when(F.col("_scale").isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.col(weight) * F.col("_scale"))))).drop("_scale")


def rebalance(rows: DataFrame, day: str, held: str, target: str, most: float, bps: float) -> DataFrame:
    """Move towards the target within a one-way turnover limit; add ``after`` and the day's ``turnover`` and ``cost``."""
    whole = F.sum(F.abs(F.col(target) - F.col(held))).over(Window.partitionBy(day)) / 2
    out = rows.withColumn("_t", whole).withColumn("_step", F.when(F.col("_t") > 0, F.least(F.lit(1.0), most / F.col("_t"))).otherwise(1.0))
    out = out.withColumn("after", F.col(held) + F.col("_step") * (F.col(target) - F.col(held)))
    out = out.withColumn("turnover", F.col("_t") * F.col("_step"))
    return out.withColumn("cost", F.col("turnover") * bps / 10_000).drop("_t", "_step")
