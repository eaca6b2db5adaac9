"""Stress scenarios: factor moves over named windows, the scenario of a signal, and combinations of scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrisk.operators.market import asof_values
from quillrisk.operators.portfolio import severity_multiplier, strongest_moves


def measure_windows(windows: DataFrame, series: DataFrame, factors: DataFrame) -> DataFrame:
    """``(name, factor, move)``: what each factor did from the last value on or before a window's start to the one on or before its end.

    ``windows``: ``name, start, end`` (dates); ``series``: ``symbol, session, value``; ``factors``: ``factor, symbol, kind, scale, proxy``. A kind is ``return``, ``difference``
    (times ``scale``, for units such as basis points) or ``inverse`` (the return of one over the series, as of a currency quoted per unit of another). A move that the
    factor's own series does not give (it starts later, or is absent) is the return of ``proxy``; without one it is null. Windows and factors are small tables; only
    the symbols that factors name are read from the series. Repeated windows or factors are computed once.
    """
    wanted = factors.select(F.explode(F.array("symbol", "proxy")).alias("symbol")).where("symbol IS NOT NULL").distinct()
    ends = F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col("start").alias("t")), F.struct(F.lit("y").alias("side"), F.col("end").alias("t")))).alias("p")
    points = windows.distinct().select("name", "start", "end", ends).select("name", "start", "end", "p.side", "p.t").crossJoin(wanted)  # a row a window, side and symbol
    known = series.join(wanted, "symbol", "left_semi").select("symbol", F.col("session").alias("t"), "value")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    values = asof_values(points, known).groupBy("name", "symbol").agg(side("x").alias("x"), side("y").alias("y"))
    each = windows.select("name").distinct().crossJoin(factors.distinct())  # the result's rows
    own = each.join(values, ["name", "symbol"], "left")
    proxies = values.select("name", F.col("symbol").alias("proxy"), (F.try_divide("y", "x") - 1).alias("_proxy"))
    ratio = F.try_divide("y", "x")
    move = F.when(F.col("kind") == "return", ratio - 1).when(F.col("kind") == "difference", (F.col("y") - F.col("x")) * F.col("scale")).when(F.col("kind") == "inverse", F.try_divide(F.lit(1.0), ratio) - 1)
    return own.join(proxies, ["name", "proxy"], "left").select("name", "factor", F.coalesce(move, "_proxy").alias("move"))


def before_cutoff(windows: DataFrame, cutoff: str, late: str = "raise") -> DataFrame:
    """Windows that end by ``cutoff``. Later ones would let a calibration see what it is tested on: they raise, or go if ``late`` is ``drop``."""
    inside = F.col("end") <= F.lit(cutoff).cast("date")
    if late == "raise":
        wrong = windows.where(~inside).select("name").limit(5).collect()  # five names at most
        if wrong:
            raise ValueError(f"windows end after {cutoff}: {', '.join(sorted(r['name'] for r in wrong))}")
    return windows.where(inside)


def build_scenarios(signals: DataFrame, mapping: DataFrame, calibration: DataFrame, multipliers: dict[int, float], severe_from: int = 10) -> DataFrame:
    """``(id, scenario, severity, factor, value, driver)`` for each signal whose class has a market-wide scenario; others are absent.

    ``signals``: ``id, event_class, impact, sub``; ``mapping``: ``event_class, rule, analogue, place``; ``calibration``: ``analogue, factor, value``. The rule is ``severe`` from
    ``severe_from`` on, else the signal's ``sub``, each if the class has it, else ``default``. Per factor the largest move of the rule's analogues counts, the first
    place among equals, times the severity's multiplier. Signals ask for few scenarios: moves are chosen once per class and rule and joined to the signals.
    """
    moves = mapping.join(calibration.where("value IS NOT NULL"), "analogue").select("event_class", "rule", "factor", "value", "analogue", "place")
    chosen = strongest_moves(moves, ["event_class", "rule"])
    rules = mapping.groupBy("event_class").agg(F.collect_set("rule").alias("_rules"))  # a row a class
    has = lambda c: F.coalesce(F.array_contains("_rules", c), F.lit(False))
    rule = F.when((F.col("impact") >= severe_from) & has(F.lit("severe")), "severe").when(has(F.col("sub")), F.col("sub")).otherwise("default")
    out = signals.select("id", "event_class", "impact", "sub").join(rules, "event_class").withColumn("rule", rule).join(chosen, ["event_class", "rule"])
    severity = severity_multiplier(F.col("impact"), multipliers)
    return out.select("id", F.concat_ws(":", "event_class", "rule").alias("scenario"), severity.alias("severity"), "factor", (F.col("value") * severity).alias("value"), "driver")


def combine_scenarios(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(by, scenario, severity, analogues, factor, value, driver)``: concurrent scenarios as one, per factor the largest shock, nothing added up.

    ``rows``: ``by, place, scenario, severity, analogues`` (an array), ``factor, value, driver``; ``place`` orders the scenarios of a group and settles ties. Names are joined by
    ``+``, the severity is the highest, analogues are a sorted union; a driver is named with its scenario unless the group has but one. A scenario named twice is one. Null values count for nothing.
    """
    rows = rows.where("value IS NOT NULL")
    best = F.max_by(F.struct("value", "scenario", "driver"), F.struct(F.abs("value"), -F.col("place")))
    factors = rows.groupBy(*by, "factor").agg(best.alias("_m"))
    # Scenarios come from a fixed set of classes and rules, so a group's sets of names and analogues stay small.
    each = rows.groupBy(*by, "scenario").agg(F.min("place").alias("place"), F.max("severity").alias("severity"), F.array_distinct(F.flatten(F.collect_set("analogues"))).alias("analogues"))
    whole = each.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "scenario"))), lambda s: s["scenario"]), "+").alias("scenario"),
        F.max("severity").alias("severity"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("analogues")))).alias("analogues"),
        F.count("*").alias("_n"),
    )
    driver = F.when(F.col("_n") == 1, F.col("_m.driver")).otherwise(F.concat(F.col("_m.scenario"), F.lit("/"), F.coalesce("_m.driver", F.lit(""))))
    return factors.join(whole, by).select(*by, "scenario", "severity", "analogues", "factor", F.col("_m.value").alias("value"), driver.alias("driver"))


def trigger_key(event_class: Column, regions: Column, macro_of: dict[str, str], world: str = "Global") -> Column:
    """Class and macro-region of a signal; regions of several macro-regions, of none, or unknown ones mean the whole world. Null regions count as none."""
    table = F.create_map(*[F.lit(x) for kv in macro_of.items() for x in kv])
    macros = F.array_distinct(F.transform(F.coalesce(regions, F.array().cast("array<string>")), lambda r: F.coalesce(F.try_element_at(table, r), F.lit(world))))
    return F.concat(event_class, F.lit("|"), F.when(F.size(macros) == 1, F.get(macros, F.lit(0))).otherwise(world))
