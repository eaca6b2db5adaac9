"""Edit-distance joins on planted edits and vector joins, against all pairs."""

import random

import numpy as np
import pytest

from quillrisk.operators import features, fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out) + 1)
        rng.choice([lambda: out.insert(k, rng.choice("abz ")), lambda: out and out.pop(min(k, len(out) - 1)), lambda: out and out.__setitem__(min(k, len(out) - 1), "q")])()
    return "".join(out)


@pytest.mark.parametrize("ratio", [0.9, 0.8])
def test_close_texts(spark, ratio):
    rng = random.Random(7)
    words = ["shares", "fall", "bank", "rise", "the", "of", "profit", "warns", "as", "talks"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(40)] + ["a", "ab", "abc", "", "abcdefghij", "漢字かな漢字かな漢字"]
    known = [(i, t) for i, t in enumerate(base)] + [(900, None), (901, base[0])]
    pool = [(1000 + i, edited(rng, rng.choice(base), rng.randrange(0, 9))) for i in range(150)] + [(2000, None), (2001, base[3]), (2001, base[4]), (2002, ""), (2003, "ab")]
    df = lambda rows: spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = sorted(tuple(r) for r in fuzzy.close_texts(df(pool), df(known), "id", "text", ratio).collect())
    want = []
    for i, a in pool:
        for j, b in known:
            if a is not None and b is not None and (d := distance(a, b)) <= int((1 - ratio) * max(len(a), len(b)) + 1e-9):
                want.append((i, j, d))
    assert got == sorted(want) and sum(d > 0 for *_, d in want) > 20


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 8))
    make = lambda n, at: [(at + i, (centre[rng.integers(12)] + rng.normal(size=8) * 0.4).tolist()) for i in range(n)]
    pool, known = [*make(200, 0), (500, None), (501, [0.0] * 8)], [*make(60, 1000), (2000, None), (2001, [0.0] * 8)]
    df = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    k = np.array([unit(v) for i, v in known if i < 2000])
    want = {i: float((k @ unit(v)).max()) for i, v in pool if i < 500}
    for points, tile in ((5, 7), (256, 4096)):
        got = {r.id: r.near for r in fuzzy.near_vectors(df(pool), df(known), "id", "v", 0.9, points, tile).collect()}
        assert got == pytest.approx({i: w for i, w in want.items() if w >= 0.9}) and 20 < len(got) < 200
    assert fuzzy.near_vectors(df(pool), df(known).where("false"), "id", "v", 0.9).count() == 0


def test_exclusion(spark):
    kind = "id long, e array<double>, key string, title string"
    known = spark.createDataFrame([(1, [1.0, 0.0], "one", "Bank shares fall on profit warning"), (2, None, None, None)], kind)
    pool = spark.createDataFrame([(1, [0.0, 1.0], "x", "x"), (3, [0.0, 1.0], "one", "y"), (4, [0.9, 0.1], "z", "z"), (5, [0.0, 1.0], "v", "Bank shares fell on profit warning"), (6, None, None, None), (7, [0.0, 1.0], "w", "Bank shares rise")], kind)
    assert {r.id for r in features.exclude_similar(pool, known, "id", "e", "key", 0.8, "title").collect()} == {6, 7}
    assert features.exclude_similar(pool, known.where("false"), "id", "e", "key", 0.8, "title").count() == 6


def test_long_texts_are_not_copied_for_every_run_of_letters(spark, monkeypatch):
    """Two texts of 20,000 letters: once each run of letters had a copy of its text, 400 MB a text."""
    rng = random.Random(11)
    long = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    df = lambda rows: spark.createDataFrame(rows, "id long, text string")
    widest = []
    real = fuzzy.durable
    monkeypatch.setattr(fuzzy, "durable", lambda rows, name: widest.append(rows) or real(rows, name))
    got = fuzzy.close_texts(df([(1, edited(rng, long, 40)), (2, "x" + long[:15_000])]), df([(3, long), (4, long[::-1])]), "id", "text")
    assert [(r.id, r.known_id) for r in got.collect()] == [(1, 3)]
    blocks = [fuzzy._blocks(df([(0, long)]).selectExpr("unhex(md5(text)) AS a", "text"), "a", 0.1, parted) for parted in (True, False)]
    assert all("text" not in b.columns for b in blocks) and blocks[0].count() == 20_000 // 9 + 1 and blocks[1].count() < 4 * 20_000


def test_vectors_are_sent_once_a_tile(spark, monkeypatch):
    """All angles allow all groups of known vectors: a row was sent to each of them, from Python, before anything was compared."""
    monkeypatch.setattr(fuzzy, "LOT", 64)
    rng = np.random.default_rng(5)
    make = lambda n, at: spark.createDataFrame([(at + i, rng.normal(size=16).tolist()) for i in range(n)], "id long, v array<double>")
    pool, known = make(300, 0), make(40, 1000)
    near = fuzzy.near_vectors(pool, known, "id", "v", 0.3, tile=16)
    assert "MapInPandas" not in near._jdf.queryExecution().toString()
    a, b = (np.array([r.v for r in rows.orderBy("id").collect()]) for rows in (pool, known))
    want = (a @ b.T / np.linalg.norm(b, axis=1)).max(axis=1) / np.linalg.norm(a, axis=1)
    got = {r.id: r.near for r in near.collect()}
    assert got == pytest.approx({i: w for i, w in enumerate(want) if w >= 0.3}) and len(got) > 100
