from random import Random

import pytest
from conftest import MEDIUM
from pyspark.sql import functions as F

from quillrisk.operators import portfolio
from quillrisk.plans import models as M

HOUR = 3_600_000_000
FIELDS = "position long, asset_class string, instrument string, rating string, sector string, region string, currency string, short boolean, " + ", ".join(
    f"{c} double" for c in ("notional", "market_value", "maturity", "duration", "convexity", "dv01", "spread_dv01", "spread_ratio", "delta", "gamma", "vega", "ead", "pd", "lgd", "spread_duration", "beta")
)


def book(spark, *rows):
    blank = dict.fromkeys(c.split()[0] for c in FIELDS.split(", "))
    return spark.createDataFrame([tuple((blank | {"position": i, "region": "US", "short": False} | r).values()) for i, r in enumerate(rows)], FIELDS)


def priced(spark, positions, **moves):
    return {r.position: r for r in portfolio.revalue(positions, M.scenarios(spark, {"run": moves}), 100.0).collect()}


def test_signs_and_amounts(spark):
    rows = [
        {"asset_class": "bond", "instrument": "corporate_bond", "rating": "BBB", "spread_ratio": 1.0, "market_value": 1e6, "duration": 5.0, "convexity": 30.0, "maturity": 12.0},
        {"asset_class": "bond", "instrument": "sovereign_bond", "rating": "BBB", "spread_ratio": 1.0, "market_value": 1e6, "duration": 5.0, "convexity": 30.0, "maturity": 0.1},
        {"asset_class": "derivative", "instrument": "irs", "dv01": 500.0, "maturity": 10.0, "short": True},
        {"asset_class": "derivative", "instrument": "cds", "spread_dv01": 400.0, "rating": "BB", "spread_ratio": 2.0, "short": True},
        {"asset_class": "loan", "instrument": "loan", "rating": "BB", "spread_ratio": 2.0, "ead": 1e6, "pd": 0.02, "lgd": 0.4, "spread_duration": 3.0, "region": "EUROPE"},
        {"asset_class": "derivative", "instrument": "equity_option", "delta": 10.0, "gamma": 0.5, "vega": 100.0, "sector": "tech"},
        {"asset_class": "derivative", "instrument": "fx_forward", "notional": 1e6, "currency": "EUR"},
        {"asset_class": "derivative", "instrument": "equity_trs", "notional": 1e6, "sector": "none"},
        {"asset_class": "equity", "instrument": "equity"},
        {"asset_class": "bond", "instrument": "corporate_bond", "market_value": 1e6, "duration": 5.0},
    ]
    got = priced(spark, book(spark, *rows), rate_3m=50.0, rate_10y=100.0, credit=200.0, equity=-0.1, vol=10.0, fx={"EUR": -0.02}, sectors={"tech": -0.2}, regions=["EUROPE", "US"])
    dy = 0.03
    assert got[0].pnl == pytest.approx(1e6 * (-5 * dy + 15 * dy * dy))
    assert got[1].pnl == pytest.approx(1e6 * (-5 * 0.005 + 15 * 0.005**2))  # no spread move; the short end of the curve
    assert got[2].pnl == pytest.approx(-500 * 100) and got[3].pnl == pytest.approx(-400 * 400)  # receiving fixed, protection sold
    assert got[4].pnl == 0 and got[4].loan_fv == pytest.approx(-3 * 0.04 * 1e6) and got[4].pd_stressed == pytest.approx(0.02 * 3 * 1.5)
    assert got[4].d_el == pytest.approx((0.09 - 0.02) * 0.4 * 1e6) and got[4].impact == pytest.approx(-got[4].d_el)
    assert got[5].pnl == pytest.approx(10 * -20 + 0.25 * 400 + 100 * 0.1)
    assert got[6].pnl == pytest.approx(-20_000) and got[7].pnl == pytest.approx(-100_000) and got[8].pnl == 0
    assert got[9].pnl == pytest.approx(1e6 * -5 * (0.005 + 0.005 * 0.75 / 9.75))  # unrated: no spread; no maturity: one year
    capped = priced(spark, book(spark, rows[4]), credit=1e6)
    assert capped[0].pd_stressed == 1 and priced(spark, book(spark, rows[4]), credit=-500.0)[0].pd_stressed == 0


def test_pricing(spark):
    one = spark.range(1).select(
        portfolio.annuity(F.lit(0.0), F.lit(5.0)).alias("flat"), portfolio.annuity(F.lit(0.04), F.lit(2.0)).alias("two"), portfolio.annuity(F.lit(0.04), F.lit(0.01)).alias("least"),
        portfolio.swap_dv01(F.lit(1e6), F.lit(0.0), F.lit(5.0)).alias("dv01"), portfolio.cds_risky_duration(F.lit(0.0), F.lit(0.4), F.lit(0.0), F.lit(3.0)).alias("safe"),
        portfolio.black_scholes(F.lit(100.0), F.lit(100.0), F.lit(1.0), F.lit(0.05), F.lit(0.2)).alias("call"), portfolio.black_scholes(F.lit(100.0), F.lit(100.0), F.lit(1.0), F.lit(0.05), F.lit(0.2), False).alias("put"),
    ).first()
    assert one.flat == pytest.approx(5) and one.two == pytest.approx(sum(1.02**-k for k in (1, 2, 3, 4)) / 2) and one.least == pytest.approx(0.5 / 1.02)
    assert one.dv01 == pytest.approx(500) and one.safe == pytest.approx(3)
    assert one.call.price == pytest.approx(10.4506, abs=1e-4) and one.put.price == pytest.approx(5.5735, abs=1e-4)
    assert one.call.delta - one.put.delta == pytest.approx(1) and one.call.gamma == one.put.gamma


def test_capital(spark):
    rows = [{"asset_class": "loan", "instrument": "loan", "rating": "BBB", "ead": 100.0, "pd": 0.1, "lgd": 0.5, "spread_ratio": 1.0}, {"asset_class": "equity", "instrument": "equity", "market_value": 100.0}]
    values = portfolio.revalue(book(spark, *rows), M.scenarios(spark, {"a": {"equity": -0.5, "credit": 100.0}}), 100.0)
    weight = portfolio.risk_weight({"BBB": 0.75, "UNRATED": 1.0}, {}, 2.5)
    got = portfolio.capital_view(values, weight).first()
    assert got.rwa_before == pytest.approx(325) and got.rwa_after == pytest.approx(75 + 125) and got.losses == pytest.approx(50 + 5)
    assert got.cet1_after == pytest.approx(0.13 * 325 - 55)


def brute_cooldown(rows, hours=24):
    state, out = {}, {}
    for key, t, seq, impact in sorted(rows, key=lambda r: (r[1], r[2])):
        at, level = state.get(key, (None, 0))
        cold = at is not None and t - at < hours * HOUR
        out[seq] = "fired" if not cold else "escalation" if impact > level else "cooldown"
        if out[seq] != "cooldown":
            state[key] = t, impact
    return out


def test_cooldown_is_a_fold(spark):
    rng = Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(0, 900) * HOUR, i, rng.randrange(1, 11)) for i in range(600)]
    rows += [("c", 0, 1000, 5), ("c", 24 * HOUR - 1, 1001, 5), ("c", 24 * HOUR, 1002, 5), ("c", 24 * HOUR, 1003, 5), ("c", 25 * HOUR, 1004, 6), ("c", 49 * HOUR - 1, 1005, 6), ("c", 49 * HOUR, 1006, 1)]
    df = spark.createDataFrame(rows, "ticker string, t long, seq long, impact int")
    got = {r.seq: r.decision for r in portfolio.cooldown(df, "ticker").collect()}
    assert got == brute_cooldown(rows) and [got[i] for i in range(1000, 1007)] == ["fired", "cooldown", "fired", "cooldown", "escalation", "cooldown", "fired"]
    assert portfolio.cooldown(df.limit(0), "ticker").count() == 0


def test_signals_of_one_key_share_a_scenario(spark):
    signals = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "none")], "seq long, name string")
    shocks = M.scenarios(spark, {"x": {"equity": -0.1}, "y": {"equity": -0.2}, "unused": {"equity": 1.0}}).withColumnRenamed("run", "name")
    got = {r.seq: r.pnl for r in portfolio.stress_many(signals, shocks, ["name"], M.positions(spark, MEDIUM), 110.0).collect()}
    assert set(got) == {1, 2, 3} and got[1] == got[2] != got[3]


def test_condensed_book_has_few_rows_and_the_same_totals(spark):
    book = M.positions(spark, MEDIUM)
    few = portfolio.condense(book)
    totals = lambda rows: {r.run: r for r in portfolio.revalue(rows, M.scenarios(spark), M.BBB_BP).groupBy("run").agg(*[F.sum(c).alias(c) for c in ("pnl", "d_el", "loan_fv")]).collect()}
    want, got = totals(book), totals(few)
    assert few.count() < book.count() / 5 and set(want) == set(got)
    for run, row in want.items():
        assert all(abs(row[c] - got[run][c]) <= 1e-9 * max(1.0, abs(row[c])) for c in ("pnl", "d_el", "loan_fv"))
