"""Boosted trees: splits against all splits one by one, monotone scores, early stop, and a large ensemble from its table."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quillrisk.operators import boosting
from quillrisk.plans import learned_queries as L


def frame(spark, n, seed, noise=0.05):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 8, (n, 3)) / 8
    y = x[:, 0] - 0.7 * x[:, 1] + 0.5 * np.sin(6 * x[:, 2]) + rng.normal(size=n) * noise
    rows = [(float(a), float(b), float(c), float(t), bool(i % 4 == 0)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, later boolean"), x, y


def brute_split(x, rest, rules):
    """Every feature and value as a split of all rows."""
    value = lambda r: r.sum() / (len(r) + rules.l2)
    fall = lambda r: r.sum() ** 2 / (len(r) + rules.l2)
    found = []
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left, right = rest[x[:, f] <= cut], rest[x[:, f] > cut]
            if min(len(left), len(right)) >= rules.least and rules.monotone[f] * (value(right) - value(left)) >= 0:
                found.append((fall(left) + fall(right) - fall(rest), f, cut, value(left), value(right)))
    return max(found)


@pytest.mark.parametrize("monotone", [(0, 0, 0), (1, -1, 0), (-1, 1, 0)])
def test_first_split_is_the_best_of_all(spark, monotone):
    df, x, y = frame(spark, 400, 1)
    rules = boosting.Rules(monotone=monotone, trees=1, depth=1, rate=1.0, bins=64, patience=5)
    fitted = boosting.fit(df.withColumn("later", F.lit(False)), ["a", "b", "c"], "y", "later", rules)
    order = np.argsort(np.argsort(y)) + 1.0  # no ties in y
    rest = order / len(y) - (order / len(y)).mean()
    gain, f, cut, low, high = brute_split(x, rest, rules)
    t = fitted.trees if len(fitted.trees.roots) else None
    assert t is not None and t.feature[0] == f and t.threshold[0] == cut and fitted.gain[f] == pytest.approx(gain)
    assert t.value[t.left[0]] == pytest.approx(low) and t.value[t.right[0]] == pytest.approx(high)


def test_monotone_scores_and_early_stop(spark):
    df, x, y = frame(spark, 3000, 2)
    rules = boosting.Rules(monotone=(1, -1, 0), trees=40, depth=3, rate=0.3, patience=4, fold_every=5)
    fitted = boosting.fit(df, ["a", "b", "c"], "y", "later", rules)
    n = len(fitted.trees.roots)
    assert 5 < n <= 40 and fitted.errors[n] == min(fitted.errors) < 0.2 * fitted.errors[0]
    grid = np.array([(a, b, c) for a in np.linspace(-0.2, 1.2, 15) for b in np.linspace(-0.2, 1.2, 15) for c in np.linspace(0, 1, 8)])
    p = fitted.trees.predict(grid).reshape(15, 15, 8)
    assert (np.diff(p, axis=0) >= -1e-12).all() and (np.diff(p, axis=1) <= 1e-12).all()
    assert (np.diff(p, axis=2) > 1e-9).any() and (np.diff(p, axis=2) < -1e-9).any()
    free = boosting.fit(df, ["a", "b", "c"], "y", "later", boosting.Rules(monotone=(-1, 1, 0), trees=5))
    q = free.trees.predict(grid).reshape(15, 15, 8)
    assert (np.diff(q, axis=0) <= 1e-12).all()  # against the data, and still kept
    # noise alone: the first trees do not help and training stops
    noise = df.withColumn("y", F.rand(3))
    stopped = boosting.fit(noise, ["a", "b", "c"], "y", "later", boosting.Rules(monotone=(0, 0, 0), trees=60, rate=0.5, patience=3, l2=0.0, least=1))
    assert len(stopped.errors) < 20 and len(stopped.trees.roots) == int(np.argmin(stopped.errors))


def test_reported_errors_are_those_of_the_scores(spark):
    df, *_ = frame(spark, 800, 5)
    rules = boosting.Rules(monotone=(0, 0, 0), trees=6, fold_every=2, patience=9)
    fitted = boosting.fit(df, ["a", "b", "c"], "y", "later", rules)
    held = df.where("later").withColumn("score", boosting.score(fitted.trees, ["a", "b", "c"])).toPandas()
    share = held["y"].rank() / len(held)
    assert ((share - held["score"]) ** 2).mean() == pytest.approx(fitted.errors[len(fitted.trees.roots)])


def test_trees_read_a_row_for_equal_bins(spark, monkeypatch):
    """They once read every row for every level. Equal targets and rows that occur often count as often."""
    df, x, y = frame(spark, 3000, 6)
    df = df.select("a", "b", (F.round(F.col("c") * 4) / 4).alias("c"), F.round("y", 1).alias("y"), "later")
    df = df.union(df.where("a > 0.5"))
    read, durable = [], boosting.durable

    def spy(rows, name):
        out = durable(rows, name)
        if name == "boosting-bins":
            read.append(out)
        return out

    monkeypatch.setattr(boosting, "durable", spy)
    rules = boosting.Rules(monotone=(0, 0, 0), trees=5, fold_every=2, patience=9, rate=0.4)
    fitted = boosting.fit(df, ["a", "b", "c"], "y", "later", rules)
    cells = df.select("a", "b", "c", "later").distinct().count()
    assert len(read) == 3 and all(r.count() <= cells < 700 for r in read)
    assert read[0].agg(F.sum("n")).first()[0] == df.count()
    rows = df.withColumn("score", boosting.score(fitted.trees, ["a", "b", "c"])).toPandas()
    share = rows.groupby("later")["y"].rank() / rows.groupby("later")["y"].transform("size")
    held = rows["later"]
    assert fitted.trees.base == pytest.approx(share[~held].mean())
    assert ((share - rows["score"])[held] ** 2).mean() == pytest.approx(fitted.errors[len(fitted.trees.roots)])
    # what the rows add up to after four trees
    four = (share - fitted.trees.first(4).predict(rows[["a", "b", "c"]].to_numpy()))[~held]
    left = read[-1].where("NOT later").agg(F.sum("g"), F.sum("s")).first()
    assert left[0] == pytest.approx(four.sum(), abs=1e-6) and left[1] == pytest.approx((four**2).sum())


def walk(trees, t, x):
    at = int(trees.roots[t])
    while trees.feature[at] >= 0:
        at = int(trees.right[at] if x[trees.feature[at]] > trees.threshold[at] else trees.left[at])
    return trees.value[at]


def test_440_trees_from_a_table(spark):
    rng = np.random.default_rng(4)
    trees = boosting.Trees(base=0.25)

    def grow(depth, nodes):
        me = len(nodes)
        nodes.append(None)
        if depth == 0 or rng.random() < 0.1:
            nodes[me] = (-1, 0.0, 0, 0, float(rng.normal()))
        else:
            left = grow(depth - 1, nodes)
            right = grow(depth - 1, nodes)
            nodes[me] = (int(rng.integers(4)), float(rng.random()), left, right, 0.0)
        return me

    for _ in range(440):
        nodes = []
        grow(int(rng.integers(1, 7)), nodes)
        trees.add(nodes)
    again = boosting.Trees.read(trees.table(spark))
    x = rng.random((300, 4))
    x[0, 0] = np.nan
    want = [0.25 + sum(walk(trees, t, r) for t in range(440)) for r in x]
    assert again.predict(x) == pytest.approx(want) and trees.first(7).predict(x[:5]) == pytest.approx([0.25 + sum(walk(trees, t, r) for t in range(7)) for r in x[:5]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double, d double").withColumn("a", F.nanvl("a", F.lit(None)))
    got = {r.i: r.s for r in df.select("i", boosting.score(again, ["a", "b", "c", "d"]).alias("s")).collect()}
    assert [got[i] for i in range(300)] == pytest.approx(want)


def test_awkward_rows(spark):
    df, *_ = frame(spark, 200, 3)
    rules = boosting.Rules(monotone=(0, 0, 0), trees=3, least=5)
    odd = df.withColumn("a", F.when(F.col("b") > 0.4, F.col("a"))).withColumn("c", F.lit(1.0)).withColumn("y", F.when(F.col("b") > 0.2, F.col("y")))
    assert len(boosting.fit(odd, ["a", "b", "c"], "y", "later", rules).errors) == 4
    none = boosting.fit(df.where("false"), ["a", "b", "c"], "y", "later", rules)
    assert none.trees.predict(np.zeros((2, 3))).tolist() == [0, 0]
    flat = boosting.fit(df.withColumn("y", F.lit(1.0)), ["a", "b", "c"], "y", "later", rules)
    assert len(flat.trees.roots) == 0 and df.select(boosting.score(flat.trees, ["a", "b", "c"])).distinct().count() == 1


def test_queries(spark):
    rows = {r.later: r for r in L.e13_train_impact(spark, SMALL).collect()}
    assert set(rows) == {True, False} and all(r.spearman > 0.8 and r.trees >= 5 for r in rows.values())
