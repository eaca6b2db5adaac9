"""Backtests of weighting rules over a grid of settings, and the tilt that reaches a target."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRATEGIES = ("sentiment_tilt", "equal_weight_buy_hold", "equal_weight_rebalanced", "naive_sign_rule")
#: Columns of a setting: tilt and deadband, bounds of weights, turnover limit, cost, and the step of the sign rule.
SETTING = ("kappa", "deadband", "low", "high", "most", "bps", "step")


def panel(rows: DataFrame, day: str, name: str, ret: str, level: str, confidence: str, net: str) -> DataFrame:
    """``(day, names, ret, level, confidence, net)``: a row a day with arrays in the order of names; missing values count as 0.

    A day's row is as long as the universe, which is what a portfolio is made of.
    """
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    one = F.struct(F.col(name).alias("name"), z(ret).alias("ret"), z(level).alias("level"), z(confidence).alias("confidence"), z(net).alias("net"))
    days = rows.groupBy(F.col(day).alias("day")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    return days.select("day", F.col("all.name").alias("names"), *[F.col(f"all.{c}").alias(c) for c in ("ret", "level", "confidence", "net")])


def capped(weights: np.ndarray, low: float, high: float) -> np.ndarray:
    """``clip(scale * w, low, high)`` with the scale at which it sums to one."""
    if len(weights) * low > 1 + 1e-12 or len(weights) * high < 1 - 1e-12:
        raise ValueError("no weights between the bounds sum to one")
    lo, hi = 0.0, high / weights.min() + 1
    for _ in range(60):
        middle = (lo + hi) / 2
        lo, hi = (lo, middle) if np.clip(weights * middle, low, high).sum() >= 1 else (middle, hi)
    return np.clip(weights * hi, low, high)


def tilted(level: np.ndarray, confidence: np.ndarray, kappa: float, deadband: float, low: float, high: float) -> np.ndarray:
    """Equal weights tilted by ``exp(kappa * level * confidence)`` outside the deadband, within bounds."""
    w = np.exp(kappa * np.where(np.abs(level) < deadband, 0.0, level) * confidence) / len(level)
    return capped(w / w.sum(), low, high)


def _one(strategy: str, days: pd.DataFrame, s: dict[str, float]) -> pd.DataFrame:
    """One setting over all days: weights are set at a close, earn the next day's returns less the cost, and drift."""
    ret, level, confidence, net = (np.stack(days[c].to_list()) for c in ("ret", "level", "confidence", "net"))
    n = ret.shape[1]
    equal = np.full(n, 1 / n)
    w, out = equal, []
    for k in range(len(ret) - 1):
        target, most = w, 0.0
        if strategy == "sentiment_tilt":
            target, most = tilted(level[k], confidence[k], s["kappa"], s["deadband"], s["low"], s["high"]), s["most"]
        elif strategy == "equal_weight_rebalanced":
            target, most = equal, 1.0
        elif strategy == "naive_sign_rule":
            target, most = capped(np.maximum(equal + s["step"] * net[k], 1e-6), s["low"], s["high"]), 1.0
        turnover = np.abs(target - w).sum() / 2
        part = min(1.0, most / turnover) if turnover > 0 else 1.0
        w, turnover = w + part * (target - w), turnover * part
        gross, cost = float(w @ ret[k + 1]), turnover * s["bps"] / 10_000
        out.append((gross - cost, gross, turnover, cost, float(np.abs(w - equal).mean())))
        w = w * (1 + ret[k + 1]) / (1 + gross)
    rows = pd.DataFrame(out, columns=["net_ret", "gross", "turnover", "cost", "active"])
    rows.insert(0, "day", days["day"].to_numpy()[1:])
    return rows


def run_backtest(days: DataFrame, settings: DataFrame) -> DataFrame:
    """``(setting, strategy, day, net_ret, gross, turnover, cost, active)``; ``settings``: ``setting, strategy`` and ``SETTING``.

    Weights depend on the day before, so a setting is one group: its calendar, a row a day. Settings run side by side. Days of other universes than the
    first day's are an error; fewer than two days give no rows.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("day", ignore_index=True)
        first = rows.iloc[0]
        if any(list(x) != list(first["names"]) for x in rows["names"]):
            raise ValueError("all days need the same names")
        out = _one(first["strategy"], rows, {c: float(first[c]) for c in SETTING})
        out.insert(0, "strategy", first["strategy"])
        out.insert(0, "setting", first["setting"])
        return out

    both = settings.crossJoin(days)  # every setting goes through every day: this product is the work
    kind = days.schema["day"].dataType.simpleString()
    return both.groupBy("setting").applyInPandas(run, f"setting string, strategy string, day {kind}, net_ret double, gross double, turnover double, cost double, active double")


def summary(runs: DataFrame, year: int = 252) -> DataFrame:
    """``(setting, strategy, days, total, volatility, turnover, cost)``."""
    total = F.exp(F.sum(F.log1p("net_ret"))) - 1
    return runs.groupBy("setting", "strategy").agg(
        F.count("*").alias("days"), total.alias("total"), (F.stddev_samp("net_ret") * F.sqrt(F.lit(float(year)))).alias("volatility"), F.avg("turnover").alias("turnover"), F.sum("cost").alias("cost")
    )


def calibrate_kappa(days: DataFrame, target: float, deadband: float, low: float, high: float, top: float = 100.0, points: int = 32, rounds: int = 4) -> DataFrame:
    """``(kappa, achieved, target, reachable)``: the tilt at which the median distance of weights from equal ones is ``target``.

    The median rises with kappa, so each round values ``points`` of the bracket in one job and keeps the piece that holds the
    target: four rounds of 32 leave a millionth of it. A target that ``top`` does not reach is flagged. Only signals are used.
    """
    spark = days.sparkSession

    def distances(rows):
        for batch in rows:
            out = []
            for kappa, level, confidence in zip(batch["kappa"], batch["level"], batch["confidence"]):
                out.append(np.abs(tilted(np.asarray(level), np.asarray(confidence), kappa, deadband, low, high) - 1 / len(level)))
            yield pd.DataFrame({"kappa": batch["kappa"], "active": out})

    def medians(kappas: list[float]) -> dict[float, float]:
        grid = spark.createDataFrame([(float(k),) for k in kappas], "kappa double")
        each = days.select("level", "confidence").crossJoin(grid).mapInPandas(distances, "kappa double, active array<double>")
        return {r["kappa"]: r["m"] for r in each.select("kappa", F.explode("active").alias("a")).groupBy("kappa").agg(F.percentile("a", 0.5).alias("m")).collect()}  # a row a point

    lo, hi = 0.0, top
    found = medians([hi]).get(hi)
    reachable = found is not None and found >= target
    for _ in range(rounds if reachable else 0):
        values = medians([lo + (hi - lo) * k / points for k in range(1, points + 1)])
        lo = max([lo, *(k for k, m in values.items() if m < target)])
        hi = min(k for k in values if k > lo)
    kappa = (lo + hi) / 2 if reachable else top
    achieved = medians([kappa]).get(kappa)
    return spark.createDataFrame([(kappa, achieved, target, reachable)], "kappa double, achieved double, target double, reachable boolean")


def excess_over_flat(results: DataFrame, by: str, kappa: str = "kappa", value: str = "total") -> DataFrame:
    """Add ``excess`` over the row of the same ``by`` whose kappa is 0."""
    flat = F.max(F.when(F.col(kappa) == 0, F.col(value))).over(Window.partitionBy(by))  # a row a setting
    return results.withColumn("excess", F.col(value) - flat)
