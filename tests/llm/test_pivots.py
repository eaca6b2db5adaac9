import math

import numpy as np
from conftest import MEDIUM

from quillrisk.llm import pivots
from quillrisk.session import table


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    x = np.stack([v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max() for _, v in good])
    near = x @ x.T >= threshold
    root = np.array([i for i, _ in good])
    while True:
        new = np.array([root[n].min() for n in near])
        if (new == root).all():
            return {i: (int(n.sum()) - 1, int(r)) for (i, _), n, r in zip(good, near, root)}
        root = new


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id string")


def check(df, least_recall=1.0, **args):
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    want = brute(rows)
    got = {r.id: (r.n_links, r.component_id) for r in pivots.near_duplicates(df, **args).collect()}
    assert set(got) == {i for i, _ in rows}
    found, all_links = sum(got[i][0] for i in want), sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= least_recall * all_links
    if least_recall == 1:
        assert all(got[i] == want[i] for i in want)
    assert all(got[i] == (0, i) for i, _ in rows if i not in want)


def planted(seed=0, groups=30, dim=32):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).tolist()) for i in range(300)]
    for g in range(groups):
        v = np.array(rows[g][1])
        for _ in range(int(rng.integers(1, 6)) if g else 120):
            rows.append((len(rows), (v + rng.normal(size=dim) * np.linalg.norm(v) * rng.uniform(0, 0.06)).tolist()))
    return rows


def test_against_all_pairs(spark):
    check(frame(spark, planted()), 0.97, pivots=32)
    check(frame(spark, planted(1)), 0.97, pivots=32, tile=16)
    check(table(spark, MEDIUM, "embeddings"))


def test_recall_with_production_parameters_and_with_many_pivots(spark):
    """Groups of six around a thousand centres: links found over links by brute force."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(1000, 64))
    x = np.repeat(centres, 6, axis=0) * rng.uniform(0.5, 2, (6000, 1))
    x += rng.normal(size=x.shape) * np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0, 0.04, (6000, 1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sum(int((unit[g : g + 6] @ unit[g : g + 6].T >= 0.95).sum()) - 6 for g in range(0, 6000, 6))
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    for many in (None, 1024):
        got = sum(r.n_links for r in pivots.near_duplicates(df, pivots=many).collect())
        print(f"recall with {many or pivots.pivots_for(6000)} pivots: {got / want:.4f} of {want}")
        assert 0.97 * want <= got <= want


def test_equal_vectors_are_one_entry(spark):
    rows = [(i, [1.0, 2.0, 3.0 + (i % 3) * 0.01]) for i in range(900)] + [(900, [3.0, -1.0, 0.0])] + [(i, [-2.0, 1.0, 0.5]) for i in (3, 4, 950)]
    check(frame(spark, [r for r in rows if r[0] not in (3, 4)] + rows[-3:]))


def test_awkward_rows(spark):
    rows = planted(2)[:350]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [math.nan] + [1.0] * 31), (1004, [None] + [1.0] * 31), (1005, [math.inf] * 32)]
    rows += [(1006, [x * 1e200 for x in rows[7][1]]), (1007, [x * 1e-200 for x in rows[7][1]]), (1008, [1.0, 2.0])]
    df = frame(spark, rows)
    got = {r.id: r for r in pivots.near_duplicates(df, pivots=32).collect()}
    assert got[1007].component_id == got[1006].component_id == got[7].component_id == 7
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (*range(1000, 1006), 1008))
    assert pivots.near_duplicates(frame(spark, [])).count() == 0
    assert [(r.n_links, r.component_id) for r in pivots.near_duplicates(frame(spark, [(1, [0.0]), (2, None)])).orderBy("id").collect()] == [(0, 1), (0, 2)]
    twice = pivots.near_duplicates(frame(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0])])).collect()
    assert sorted((r.id or 0, r.n_links) for r in twice) == [(0, 0), (1, 2), (1, 2), (2, 2)]
