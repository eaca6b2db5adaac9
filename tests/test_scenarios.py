"""Windows, calibration, scenarios of signals, combinations and keys on small rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillrisk.operators import scenarios

D = dt.date


def test_windows_units_proxies_and_inverse(spark):
    series = [("m", D(2020, 1, 1), 100.0), ("m", D(2020, 2, 1), 90.0), ("new", D(2020, 1, 20), 5.0), ("rate", D(2019, 12, 1), 1.5), ("rate", D(2020, 1, 30), 1.0), ("rate", D(2020, 1, 31), None), ("yen", D(2020, 1, 1), 100.0), ("yen", D(2020, 1, 9), 125.0)]
    factors = [("eq", "m", "return", 1.0, None), ("sector", "new", "return", 1.0, "m"), ("bp", "rate", "difference", 100.0, None), ("jpy", "yen", "inverse", 1.0, None), ("none", "absent", "return", 1.0, None), ("other", "absent", "return", 1.0, "m")]
    out = scenarios.measure_windows(
        spark.createDataFrame([("w", D(2020, 1, 10), D(2020, 2, 10)), ("v", D(2020, 1, 5), D(2020, 1, 12)), ("early", D(2000, 1, 1), D(2001, 1, 1))], "name string, start date, end date"),
        spark.createDataFrame(series, "symbol string, session date, value double"),
        spark.createDataFrame([*factors, factors[0]], "factor string, symbol string, kind string, scale double, proxy string"),
    ).collect()
    assert len(out) == 18
    got = {(r.name, r.factor): r.move for r in out}
    assert got["w", "eq"] == got["w", "sector"] == got["w", "other"] == pytest.approx(-0.1) and got["w", "bp"] == pytest.approx(-50) and got["w", "jpy"] == 0
    assert got["v", "jpy"] == pytest.approx(-0.2) and got["v", "eq"] == 0 and got["w", "none"] is None and all(got["early", f[0]] is None for f in factors)


def test_cutoff(spark):
    windows = spark.createDataFrame([("a", D(2020, 1, 1), D(2020, 6, 1)), ("late", D(2020, 1, 1), D(2021, 6, 1))], "name string, start date, end date")
    with pytest.raises(ValueError, match="late"):
        scenarios.before_cutoff(windows, "2020-12-31")
    assert [r.name for r in scenarios.before_cutoff(windows, "2020-12-31", late="drop").collect()] == ["a"]
    assert scenarios.before_cutoff(windows, "2021-12-31").count() == 2


def test_rules_severity_and_drivers(spark):
    mapping = spark.createDataFrame([("CREDIT", "default", "p", 0), ("CREDIT", "default", "q", 1), ("CREDIT", "severe", "s", 0), ("MACRO", "default", "p", 0), ("MACRO", "hawkish", "q", 0)], "event_class string, rule string, analogue string, place int")
    calibration = spark.createDataFrame([("p", "eq", -0.1), ("q", "eq", 0.1), ("p", "oil", 0.2), ("q", "oil", -0.4), ("s", "eq", -0.9), ("s", "oil", None)], "analogue string, factor string, value double")
    signals = [(1, "CREDIT", 9, "hawkish"), (2, "CREDIT", 10, None), (3, "MACRO", 10, "hawkish"), (4, "MACRO", 8, "growth"), (5, "MERGER", 10, None), (6, "CREDIT", 5, None), (7, None, 10, None)]
    out = scenarios.build_scenarios(spark.createDataFrame(signals, "id long, event_class string, impact int, sub string"), mapping, calibration, {8: 0.6, 9: 0.8, 10: 1.0})
    got = {(r.id, r.factor): (r.scenario, r.severity, round(r.value, 9), r.driver) for r in out.collect()}
    assert got == {
        (1, "eq"): ("CREDIT:default", 0.8, -0.08, "p"), (1, "oil"): ("CREDIT:default", 0.8, -0.32, "q"), (2, "eq"): ("CREDIT:severe", 1.0, -0.9, "s"),
        (3, "eq"): ("MACRO:hawkish", 1.0, 0.1, "q"), (3, "oil"): ("MACRO:hawkish", 1.0, -0.4, "q"), (4, "eq"): ("MACRO:default", 0.6, -0.06, "p"), (4, "oil"): ("MACRO:default", 0.6, 0.12, "p"),
        (6, "eq"): ("CREDIT:default", 0.0, 0.0, "p"), (6, "oil"): ("CREDIT:default", 0.0, 0.0, "q"),
    }


def test_combination_is_not_a_sum(spark):
    fields = "g int, place int, scenario string, severity double, analogues array<string>, factor string, value double, driver string"
    rows = [(1, 0, "a", 0.6, ["z", "p"], "eq", -0.1, "p"), (1, 1, "b", 1.0, ["p", "c"], "eq", -0.2, "c"), (1, 0, "a", 0.6, ["z", "p"], "oil", 0.05, "z"), (1, 1, "b", 1.0, ["p", "c"], "oil", -0.05, "c"), (1, 2, "c", 9.0, ["n"], "oil", None, None), (2, 5, "a", 0.6, ["p"], "eq", 0.3, "p")]
    got = {(r.g, r.factor): r for r in scenarios.combine_scenarios(spark.createDataFrame(rows, fields), ["g"]).collect()}
    assert len(got) == 3 and got[1, "eq"].value == -0.2 and got[1, "oil"].value == 0.05
    assert (got[1, "eq"].scenario, got[1, "eq"].severity, got[1, "eq"].analogues, got[1, "eq"].driver, got[1, "oil"].driver) == ("a+b", 1.0, ["c", "p", "z"], "b/c", "a/z")
    assert (got[2, "eq"].scenario, got[2, "eq"].driver) == ("a", "p")


def test_trigger_key(spark):
    rows = [(1, ["US", "CA"]), (2, ["US", "DE"]), (3, ["XX"]), (4, []), (5, None), (6, ["DE", "DE"]), (7, ["US", "XX"]), (8, ["US", None])]
    key = scenarios.trigger_key(F.lit("C"), F.col("regions"), {"US": "Americas", "CA": "Americas", "DE": "Europe"})
    got = {r.id: r.key for r in spark.createDataFrame(rows, "id int, regions array<string>").select("id", key.alias("key")).collect()}
    assert got == {1: "C|Americas", 2: "C|Global", 3: "C|Global", 4: "C|Global", 5: "C|Global", 6: "C|Europe", 7: "C|Global", 8: "C|Global"}
