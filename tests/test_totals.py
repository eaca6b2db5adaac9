import math
from collections import defaultdict
from random import Random

import numpy as np
import pytest

from quillrisk.operators import totals


@pytest.fixture(scope="module")
def rows(spark):
    rng = Random(1)
    out = [(i, rng.choice("ab"), rng.choice([0.0, 1.5, rng.gauss(0, 100), math.exp(rng.gauss(0, 4))])) for i in range(900)]
    out += [(900 + i, "hot", 7.0) for i in range(300)] + [(1200, "one", 3.0), (1201, "a", None), (1202, "none", None)]
    return spark.createDataFrame(out, "id long, g string, v double").repartition(5)


def by_group(rows, nulls=False):
    out = defaultdict(list)
    for r in rows.collect():
        if nulls or r.v is not None:
            out[r.g].append((r.v, r.id))
    return out


def test_quantiles(rows):
    q = [0.0, 0.1, 0.5, 0.97, 1.0]
    got = {r.g: r.quantiles for r in totals.exact_quantiles(rows, "g", "v", q).collect()}
    want = by_group(rows)
    assert set(got) == set(want) and all(got[g] == pytest.approx(np.quantile([v for v, _ in want[g]], q).tolist(), rel=1e-12) for g in want)
    assert totals.exact_quantiles(rows.limit(0), "g", "v", q).count() == 0


def test_places_and_ranks(rows):
    known = rows.where("v IS NOT NULL")
    want = by_group(rows)
    placed = {r.id: r.p for r in totals.places(known, "g", "v", "id", "p").collect()}
    assert placed == {i: k for g in want for k, (_, i) in enumerate(sorted(want[g]))}
    ranked = {r.id: r.r for r in totals.average_ranks(rows, "g", "v", "r").collect()}
    for g, values in want.items():
        flat = [v for v, _ in values]
        nulls = 1 if g == "a" else 0  # nulls come first
        assert all(ranked[i] == sum(x < v for x in flat) + (flat.count(v) + 1) / 2 + nulls for v, i in values)
    assert ranked[1201] == ranked[1202] == 1


def test_running_total(spark):
    df = spark.createDataFrame([(k, b, i, i % 4) for i in range(60) for k in "xy" for b in (i // 10,)], "k string, b int, i int, n int")
    got = {(r.k, r.i): (r.s, r.c) for r in totals.running_total(totals.running_total(df, ["k"], "b", [df.i], "n", "s"), ["k"], "b", [df.i], None, "c").collect()}
    assert got == {(k, i): (sum(j % 4 for j in range(i)), i) for k in "xy" for i in range(60)}
