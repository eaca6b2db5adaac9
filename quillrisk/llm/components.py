"""Connected components of an edge table: contraction inside tasks, then large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrisk.session import durable

#: Edges that a task contracts together.
PART_EDGES = 1 << 20


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` items reaches over edges ``u, v``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        for at in (u, v, root[u], root[v]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as stars (``hi`` to the least node it reaches), up to ``PART_EDGES`` at a time."""
    held: list[np.ndarray] = []

    def stars() -> pa.RecordBatch:
        nodes, index = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        index = index.reshape(2, -1)
        root = local_roots(len(nodes), index[0], index[1])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["hi", "lo"])

    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy() for i in (0, 1)]))
        if sum(h.shape[1] for h in held) >= PART_EDGES:
            yield stars()
            held = []
    if held:
        yield stars()


def _settled(star: DataFrame) -> bool:
    """Whether every node is either a root or has a single edge, to a root."""
    ends = star.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(star.select("lo", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where("up + down > 1").limit(1).count()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``, whole numbers; ``root`` is the smallest node it reaches.

    Loops and null ends are ignored, repeated edges count once, an empty table gives an empty result.
    Tasks first contract the edges that they hold; each round after that is two joins and a table in the shared folder,
    and one yes or no reaches the driver.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    star = durable(durable(pairs, "edges").mapInArrow(_contract, "hi long, lo long").distinct(), "star")
    for _ in range(max_rounds):
        if _settled(star):
            break
        both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(star.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        star = durable(small.union(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "star")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return star.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(star.select("lo", "lo").distinct())
