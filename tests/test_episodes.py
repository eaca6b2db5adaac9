"""Episodes, the runs matched to them and the moves that came, against plain loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quillrisk.operators import episodes

DAY = 86_400_000_000


def test_episodes_and_runs(spark):
    rng = random.Random(3)
    bad = [(k, rng.randrange(200)) for k in "abc" for _ in range(70)]
    runs = [(rng.choice("ab"), rng.randrange(200) * DAY + rng.randrange(3) * 3600, i, rng.randrange(8, 11), rng.randrange(2, 4), f"s{i % 5}") for i in range(160)]
    found = episodes.episodes(spark.createDataFrame([*bad, *bad[:5], ("a", None)], "cls string, day long"), "cls", gap=2)
    want = {}
    for k in "abc":
        spans = []
        for d in sorted({d for c, d in bad if c == k}):
            if spans and d - spans[-1][1] <= 2:
                spans[-1][1] = d
            else:
                spans.append([d, d])
        want |= {(k, a): b for a, b in spans}
    assert {(r.cls, r.day): r.last_day for r in found.collect()} == want
    got = episodes.match_runs(found, spark.createDataFrame(runs, "cls string, t long, seq long, impact int, outlets long, scenario string"), "cls").collect()
    assert {(r.cls, r.day) for r in got} == want.keys()
    statuses = set()
    for r in got:
        mine = [x for x in runs if x[0] == r.cls]
        same = sorted((x for x in mine if x[1] // DAY == r.day), key=lambda x: (-x[3], -x[4], x[1], x[2]))
        prior = sorted((x for x in mine if r.day - 7 <= x[1] // DAY < r.day), key=lambda x: (-x[1], x[2]))
        chosen = (same or prior or [None])[0]
        status = "fired" if same else "missed, earlier run" if prior else "missed"
        assert (r.status, r.seq, r.scenario, r.prior_runs) == (status, chosen and chosen[2], chosen and chosen[5], len(prior))
        statuses.add(status)
    assert statuses == {"fired", "missed, earlier run", "missed"}


def test_moves_and_comparison(spark):
    first = dt.date(2020, 1, 6)
    sessions = [first + dt.timedelta(weeks=i) for i in range(12)]
    values = {("m", s): 100.0 + i * i for i, s in enumerate(sessions)} | {("late", s): 50.0 - i for i, s in enumerate(sessions) if i >= 6} | {("gap", s): 10.0 + i for i, s in enumerate(sessions) if i % 3 == 0}
    series = spark.createDataFrame([(f, s, v) for (f, s), v in values.items()], "factor string, session date, value double")
    epoch = dt.date(1970, 1, 1)
    days = [(first - epoch).days + k for k in (-3, 0, 1, 8, 20, 50, 63, 70, 90)]
    got = episodes.realised_moves(spark.createDataFrame([(d,) for d in days], "day long"), series, F.date_from_unix_date(F.col("day").cast("int")), 2).collect()
    want = {}
    for d in days:
        k = sum(s < epoch + dt.timedelta(days=d) for s in sessions)
        if k == 0 or k + 2 > len(sessions):
            continue
        for f in ("m", "late", "gap"):
            at = lambda end: next((values[f, s] for s in reversed(sessions[:end]) if (f, s) in values), None)
            if at(k) is not None:
                want[d, f] = at(k + 2) / at(k) - 1
    assert {(r.day, r.factor) for r in got} == want.keys() and all(abs(r.realised - want[r.day, r.factor]) < 1e-12 for r in got)
    matched = spark.createDataFrame([("a", days[3], "fired", "x"), ("b", days[4], "missed", None)], "cls string, day long, status string, scenario string")
    shocks = spark.createDataFrame([("x", "m", 0.1), ("x", "gap", -0.1), ("x", "absent", 1.0)], "scenario string, factor string, predicted double")
    rows = {r.factor: r for r in episodes.compare(matched, "cls", shocks, spark.createDataFrame(got)).collect()}
    assert set(rows) == {"m", "gap"} and rows["m"].same_sign and not rows["gap"].same_sign
    assert abs(rows["m"].error - (0.1 - want[days[3], "m"])) < 1e-12


def test_nothing_happened(spark):
    none = spark.createDataFrame([], "cls string, day long")
    runs = spark.createDataFrame([], "cls string, t long, seq long, impact int, outlets long, scenario string")
    assert not episodes.match_runs(episodes.episodes(none, "cls"), runs, "cls").collect()
    one = spark.createDataFrame([("a", 5)], "cls string, day long")
    assert episodes.match_runs(episodes.episodes(one, "cls"), runs, "cls").first().status == "missed"
