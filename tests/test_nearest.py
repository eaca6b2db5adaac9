"""Greatest products with earlier vectors against all pairs, comparisons counted; the bootstrap against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrisk.operators import evaluation, impact, nearest


def brute(v, at, lookback):
    out = []
    for i in range(len(v)):
        ok = [v[i] @ v[j] for j in range(len(v)) if tuple(at[j]) < tuple(at[i]) and at[j][0] >= at[i][0] - lookback]
        out.append(max(ok, default=-np.inf))
    return np.array(out)


def clustered(seed, n, groups=20, dims=16, noise=0.05):
    rng = np.random.default_rng(seed)
    return rng, rng.normal(size=(groups, dims))[rng.integers(groups, size=n)] + rng.normal(size=(n, dims)) * noise


@pytest.mark.parametrize("seed", range(4))
def test_exact_for_any_vectors(seed):
    rng, v = clustered(seed, 300, noise=[0.0, 0.05, 1.0, 5.0][seed])
    v[::50] = 0
    v *= rng.choice([0.1, 1, 3], size=(300, 1))
    at = np.stack([np.sort(rng.integers(0, 100, 300)), rng.permutation(300)], axis=1)
    got, _ = nearest.greatest_before(v, at, v, at, 30)
    assert np.allclose(got, brute(v, at, 30))


def test_far_fewer_products_than_pairs():
    _, v = clustered(9, 4000, groups=60)
    v /= np.linalg.norm(v, axis=1)[:, None]
    at = np.stack([np.arange(4000), np.arange(4000)], axis=1)
    _, worked = nearest.greatest_before(v, at, v, at, 10**9)
    assert worked < 4000 * 4000 / 8


@pytest.mark.parametrize("tile", [17, 4096])
def test_tiles_and_blocks(spark, tile):
    rng, v = clustered(5, 240)
    v /= np.linalg.norm(v, axis=1)[:, None]
    t, block = rng.integers(0, 400, 240), rng.choice(["a", "a", "a", "b", None], 240)
    rows = [(i, int(t[i]), block[i], v[i].tolist() if i % 40 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "seq long, t long, block string, v array<double>")
    want = {}
    for b in ("a", "b", None):
        mine = [i for i in range(240) if block[i] == b and i % 40]
        want |= dict(zip(mine, brute(v[mine], [(t[i], i) for i in mine], 50)))
    got = {r.seq: r for r in nearest.greatest_earlier(df, "block", "v", 50, tile).collect()}
    assert all((got[i].near is None) == (w == -np.inf) and (w == -np.inf or got[i].near == pytest.approx(w)) for i, w in want.items()) and got.keys() <= want.keys()
    fresh = {r.seq: r.novelty for r in impact.novelty(df, "block", "v", 50).collect()}
    assert len(fresh) == 240 and fresh[0] == 1 and all(fresh[i] == pytest.approx(max(0, 1 - w) if w > -np.inf else 1) for i, w in want.items())
    assert impact.novelty(df.where("false"), "block", "v", 50).count() == 0


def test_bootstrap_is_the_plain_loop(spark):
    rng = np.random.default_rng(2)
    d = rng.normal(0.3, 1, 150)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)] + [(999, None)], "id long, d double").repartition(5)
    hashes = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    cuts, means = evaluation.poisson_cuts(), []
    for draw in range(1, 201):
        num = den = 0.0
        for i, x in enumerate(d):
            h = (hashes[i] + draw * 0x9E3779B97F4A7C15) % 2**64
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
            w = sum(c <= ((h ^ h >> 31) >> 11) / 2**53 for c in cuts)
            num, den = num + w * x, den + w
        means.append(num / den)
    got = evaluation.bootstrap(df, "id", "d", 200).first()
    assert got.mean == pytest.approx(np.mean(means)) and [got.low, got.high] == pytest.approx(np.quantile(means, [0.025, 0.975]))
    assert got.low < d.mean() < got.high and abs(got.mean - d.mean()) < 0.05
    assert 0.7 * 1.96 < (got.high - got.low) / 2 / (d.std() / np.sqrt(150)) < 1.3 * 1.96
    assert evaluation.bootstrap(df.where("false"), "id", "d").first().mean is None
