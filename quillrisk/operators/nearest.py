"""The greatest dot product with earlier vectors, exactly, without comparing all pairs.

Vectors of a group are gathered around reference points. A cluster's angle from its point and the query's angle to the point bound every
product in the cluster from above (angles obey the triangle inequality), so clusters are read by falling bounds until none can beat the best found.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLACK = 1e-9


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.linalg.norm(v, axis=1)
    return v / np.where(size > 0, size, 1.0)[:, None], size


def gather(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(points, cluster, angle)`` of unit vectors: about sqrt(n) points, each the farthest from those before, and every vector's nearest with its angle."""
    n = len(units)
    points, near, cluster = [0], units @ units[0], np.zeros(n, np.int64)
    for k in range(1, math.isqrt(max(0, n - 1)) + 1):
        far = int(np.argmin(near))
        if near[far] > 1 - SLACK:
            break
        points.append(far)
        mine = units @ units[far]
        closer = mine > near
        near, cluster = np.where(closer, mine, near), np.where(closer, k, cluster)
    return np.array(points), cluster, np.arccos(np.clip(near, -1, 1))


def greatest_before(asked: np.ndarray, asked_at: np.ndarray, known: np.ndarray, known_at: np.ndarray, lookback: int) -> tuple[np.ndarray, int]:
    """``(greatest dot product or -inf, products worked out)`` for every asked vector over known ones that come before it, at most ``lookback`` earlier.

    ``*_at``: columns ``t, seq``.
    """
    best, worked = np.full(len(asked), -np.inf), 0
    if not len(known) or not len(asked):
        return best, worked
    (q, q_size), (u, u_size) = _units(asked), _units(known)
    some = np.flatnonzero(u_size > 0)
    points, cluster, angle = gather(u[some]) if len(some) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    members = [some[cluster == k] for k in range(len(points))]
    n = len(members)
    bound = np.full((len(asked), n + 1), -np.inf)
    if n:
        widest = np.array([angle[cluster == k].max() for k in range(n)])
        least, most = (np.array([f(u_size[m]) for m in members]) for f in (np.min, np.max))
        away = np.arccos(np.clip(q @ u[some[points]].T, -1, 1)) - widest - SLACK
        worked += len(asked) * n + len(some) * n
        cosine = np.cos(np.clip(away, 0, math.pi))
        bound[:, :n] = q_size[:, None] * np.where(cosine > 0, most, least) * cosine
    zero = np.flatnonzero(u_size == 0)
    members.append(zero)
    if len(zero):
        bound[:, n] = np.inf
    for k, m in enumerate(members):  # clusters without a vector in the time looked back on
        if len(m):
            out = (known_at[m, 0].min() > asked_at[:, 0]) | (known_at[m, 0].max() < asked_at[:, 0] - lookback)
            bound[out, k] = -np.inf
    order = np.argsort(-bound, axis=1, kind="stable")
    rows = np.arange(len(asked))
    for r in range(n + 1):
        k = order[rows, r]
        live = (bound[rows, k] > -np.inf) & (bound[rows, k] >= best - SLACK)
        if not live.any():
            break
        for c in np.unique(k[live]):
            mine, m = np.flatnonzero(live & (k == c)), members[c]
            dots = asked[mine] @ known[m].T
            worked += dots.size
            t, seq = asked_at[mine, 0][:, None], asked_at[mine, 1][:, None]
            before = (known_at[m, 0] < t) | ((known_at[m, 0] == t) & (known_at[m, 1] < seq))
            dots[~(before & (known_at[m, 0] >= t - lookback))] = -np.inf
            best[mine] = np.maximum(best[mine], dots.max(axis=1))
    return best, worked


def greatest_earlier(rows: DataFrame, block: str, vector: str, lookback: int, tile: int = 4096) -> DataFrame:
    """``(seq, near, worked)`` for rows with a vector: the greatest dot product with vectors of the same block in the last ``lookback``, null if there
    are none, and how many products that took.

    Rows meet in time cells as long as the look-back. A cell with more than ``tile`` rows is cut into tiles, and its queries meet one tile of
    vectors at a time, so no task holds more than two tiles. Null vectors are not looked at; a null block is a block.
    """
    cell = F.floor(F.col("t") / lookback)
    base = rows.where(F.col(vector).isNotNull()).select(F.coalesce(F.concat(F.lit("b"), F.col(block).cast("string")), F.lit("null")).alias("block"), F.col("seq").cast("long").alias("seq"), "t", F.col(vector).cast("array<double>").alias("v"), cell.alias("own"))
    counts = base.groupBy("block", "own").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    tiled = base.join(counts, ["block", "own"])
    part = F.pmod(F.xxhash64("seq"), F.col("tiles"))
    known = tiled.select("block", F.col("own").alias("cell"), part.alias("tile"), F.lit(-1).cast("long").alias("lot"), "seq", "t", "v")
    lots = counts.select("block", F.col("own").alias("cell"), F.col("tiles").alias("there"))
    asked = tiled.select("block", F.explode(F.array("own", F.col("own") - 1)).alias("cell"), (part * 2 + F.pmod("own", F.lit(2))).alias("lot"), "seq", "t", "v")
    asked = asked.join(lots, ["block", "cell"]).select("block", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("there") - 1)).alias("tile"), "lot", "seq", "t", "v")

    def run(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        grid = lambda x: np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
        best, worked = greatest_before(grid(one["v"]), one[["t", "seq"]].to_numpy(), grid(other["v_"]), other[["t_", "seq_"]].to_numpy(), lookback)
        return pd.DataFrame({"seq": one["seq"], "near": best, "worked": worked / max(1, len(one))})

    # A lot of queries meets a copy of its tile: copies are as many as the cell and the next have lots.
    pairs = asked.select("block", "cell", "tile", "lot").distinct()
    sent = known.drop("lot").join(pairs, ["block", "cell", "tile"])
    key, other = ["block", "cell", "tile", "lot"], ["of_block", "of_cell", "of_tile", "of_lot"]
    sent = sent.select(*[F.col(k).alias(o) for k, o in zip(key, other)], *[F.col(c).alias(f"{c}_") for c in ("seq", "t", "v")])
    found = asked.groupBy(*key).cogroup(sent.groupBy(*other)).applyInPandas(run, "seq long, near double, worked double")
    return found.groupBy("seq").agg(F.max(F.when(F.col("near") > F.lit(float("-inf")), F.col("near"))).alias("near"), F.sum("worked").alias("worked"))
