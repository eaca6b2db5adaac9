"""Texts within an edit distance of known texts, and vectors near known vectors, without sending any row to all others."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrisk.functions.text import mix
from quillrisk.operators.nearest import SLACK
from quillrisk.session import durable

#: Letters of a block that are compared at most, and rows of blocks that a task holds before it hands them on.
BLOCK, HELD = 16, 1 << 17
#: Rows of the pool that meet a tile of known vectors in one task.
LOT = 16384


def _plan(size: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many letters: the most edits that any pair allows them, the letters of a block when so many edits leave one whole, and a class of sizes."""
    edits = np.floor(slack * size / (1 - slack) + 1e-6).astype(np.int64)
    level = np.floor(np.log(np.maximum(size, 1)) / max(1e-3, -math.log(1 - slack))).astype(np.int64)
    return edits, np.minimum(BLOCK, size // (edits + 1)), level


def _runs(letters: np.ndarray, starts: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(h, lo, hi)``: 64 bits of the distinct runs of ``width`` letters at ``starts``, and the first and the last start of each."""
    out = np.full(len(starts), (level << 8) + width, np.uint64)
    for k in range(width):
        out = mix(out ^ letters[starts + k]) + np.uint64(k + 1)
    h, first, index = np.unique(out, return_index=True, return_inverse=True)
    hi = np.zeros(len(h), np.int64)
    np.maximum.at(hi, index, starts)
    return h, starts[first], hi


@functools.lru_cache(4096)
def _kinds(size: int, slack: float) -> list[tuple[int, int]]:
    """``(width, level)`` of the blocks of all texts that one of ``size`` letters can be close to without being equal."""
    sizes = np.arange(max(1, math.ceil((1 - slack) * size - 1e-6)), math.floor(size / (1 - slack) + 1e-6) + 1)
    edits, width, level = _plan(sizes, slack)
    return sorted(set(zip(width[edits > 0].tolist(), level[edits > 0].tolist())))


def _blocks(rows: DataFrame, own: str, slack: float, parted: bool) -> DataFrame:
    """``(own, size_own, h, lo_own, hi_own)`` of texts: the blocks that a text is parted into, one more than the edits it allows, or all runs of letters that can equal one."""
    kind = f"{own} binary, size_{own} int, h long, lo_{own} int, hi_{own} int"
    names = [c.split()[0] for c in kind.split(", ")]

    def of(letters: np.ndarray) -> Iterator[tuple]:
        n = len(letters)
        if parted:
            edits, width, level = (int(x[0]) for x in _plan(np.array([n]), slack))
            if edits:
                yield _runs(letters, np.arange(edits + 1) * (n // (edits + 1)), width, level)
        else:
            for width, level in _kinds(n, slack):
                if width <= n:
                    yield _runs(letters, np.arange(n - width + 1), width, level)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for part in batches:
            for key, text in zip(part[own], part["text"]):
                letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                for h, lo, hi in of(letters):
                    held.append((key, len(letters), h.view(np.int64), lo, hi))
                    count += len(h)
                if count >= HELD:
                    yield _flat(held, names)
                    held, count = [], 0
        if held:
            yield _flat(held, names)

    return rows.mapInPandas(run, kind)


def _flat(held: list[tuple], names: list[str]) -> pd.DataFrame:
    n = [len(x[2]) for x in held]
    key = np.empty(len(held), object)
    key[:] = [x[0] for x in held]
    columns = [np.repeat(key, n), np.repeat([x[1] for x in held], n), *[np.concatenate([x[k] for x in held]) for k in (2, 3, 4)]]
    return pd.DataFrame(dict(zip(names, columns)))


def _banded(a: Column, b: Column, most: Column) -> Column:
    """The edit distance if it is at most ``most``, else -1. Spark works on the band of a fixed limit alone, so the limit is the next power of two."""
    out = F.levenshtein(a, b)
    for k in range(16, -1, -1):
        out = F.when(most <= 1 << k, F.levenshtein(a, b, 1 << k)).otherwise(out)
    return F.when((out >= 0) & (out <= most), out).otherwise(F.lit(-1))


def close_texts(pool: DataFrame, known: DataFrame, id_col: str, text_col: str, ratio: float = 0.9) -> DataFrame:
    """``(id, known_id, distance)``: pairs whose edit distance is at most ``1 - ratio`` (below 1) of the longer text's letters.

    A text parted into one more block than the edits it allows keeps a block whole, at most so many places off, in every text it is close to. So the
    blocks of the pool's texts are joined with the runs of letters of the known ones, where sizes and places allow, as 64 bits beside 128 bits of the text: texts themselves meet only in the
    pairs that are left, whose distance gives up beyond the limit. Equal texts are found by equality, whatever their length. Null texts match nothing;
    repeated ids are texts of their own.
    """
    if not 0 < ratio <= 1:
        raise ValueError("ratio has to be above 0 and at most 1")
    slack = 1 - ratio
    sides = [rows.select(F.col(id_col).alias("id"), F.unhex(F.md5(text_col)).alias(own), F.col(text_col).alias("text")).where("text IS NOT NULL") for rows, own in ((pool, "a"), (known, "b"))]
    sides = [durable(s, "close-texts") for s in sides]
    texts = [durable(s.select(own, "text").distinct(), "texts") for s, own in zip(sides, "ab")]
    left, right = (_blocks(t, own, slack, own == "a") for t, own in zip(texts, "ab"))
    most = F.floor(slack * F.greatest("size_a", "size_b") + 1e-9).cast("int")
    there = (F.abs(F.col("size_a") - F.col("size_b")) <= most) & (F.col("lo_a") - most <= F.col("hi_b")) & (F.col("lo_b") - most <= F.col("hi_a"))
    pairs = left.join(right, "h").where(there & (most > 0) & (F.col("a") != F.col("b"))).select("a", "b", most.alias("most")).distinct()
    both = pairs.join(texts[0].withColumnRenamed("text", "text_a"), "a").join(texts[1].withColumnRenamed("text", "text_b"), "b")
    near = both.withColumn("distance", _banded(F.col("text_a"), F.col("text_b"), F.col("most"))).where("distance >= 0").select("a", "b", "distance")
    same = texts[0].select("a").join(texts[1].select("b"), F.col("a") == F.col("b")).withColumn("distance", F.lit(0))
    return sides[0].select("id", "a").join(near.union(same), "a").join(sides[1].select(F.col("id").alias("known_id"), "b"), "b").select("id", "known_id", "distance")


def _greatest(a: np.ndarray, b: np.ndarray, threshold: float, points: int) -> np.ndarray:
    """The greatest cosine of every row of ``a`` to rows of ``b`` if it is ``threshold`` or more, else anything less. Rows of ``b`` gather around ``points`` of them;
    where angles tell that a row cannot reach most groups, it meets those alone that it can reach."""
    length = lambda x: np.linalg.norm(x, axis=1)
    best, size = np.full(len(a), -np.inf), length(b)
    whole = lambda x, y, s: np.concatenate([(x[i : i + 1024] @ y.T / s).max(axis=1) for i in range(0, len(x), 1024)])
    centres = b[:points] / size[:points, None]
    home = np.clip(b @ centres.T / size[:, None], -1, 1)
    cluster, away = home.argmax(axis=1), np.arccos(home.max(axis=1))
    wide = np.full(len(centres), -np.inf)
    np.maximum.at(wide, cluster, away)
    reach = math.acos(max(-1.0, min(1.0, threshold)))
    near = np.arccos(np.clip(a @ centres.T / length(a)[:, None], -1, 1)) <= reach + wide + SLACK
    if near.mean() > 0.5:
        best = whole(a, b, size)
    else:
        for c in np.flatnonzero(near.any(axis=0)):
            mine, members = np.flatnonzero(near[:, c]), cluster == c
            best[mine] = np.maximum(best[mine], whole(a[mine], b[members], size[members]))
    return best / length(a)


def near_vectors(pool: DataFrame, known: DataFrame, id_col: str, vector: str, threshold: float, points: int = 256, tile: int = 16384) -> DataFrame:
    """``(id, near)``: rows of ``pool`` with a cosine of ``threshold`` or more to some vector of ``known``, and the greatest.

    The pool is dealt into lots and the known vectors into tiles by hash; each lot meets each tile in one task, so a row is sent once a tile and a
    known vector once a lot, whatever their angles. Inside a task angles to ``points`` known vectors save what cannot be near. Vectors that are null, zero
    or hold other than finite numbers are near nothing.
    """
    spark = pool.sparkSession
    kind = pool.schema[id_col].dataType.simpleString()
    take = lambda rows: rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked, held = take(pool), take(known)
    n_asked, n_held = asked.count(), held.count()
    if not n_asked or not n_held:
        return spark.createDataFrame([], f"id {kind}, near double")
    lots, tiles = -(-n_asked // LOT), -(-n_held // tile)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    sent = asked.select("id", "v", dealt(lots).alias("lot"), all_of(tiles).alias("tile"))
    placed = held.select(F.col("v").alias("w"), dealt(tiles).alias("t"), all_of(lots).alias("l"))

    def best(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        grid = lambda x: np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, 0))
        real = lambda v: (lambda s: (s > 0) & np.isfinite(s))(np.linalg.norm(v, axis=1))
        a, b = grid(one["v"]), grid(other["w"])
        mine, b = real(a), b[real(b)]
        if not mine.any() or not len(b):
            return pd.DataFrame({"id": one["id"][:0], "near": np.zeros(0)})
        near = _greatest(a[mine], b, threshold, points)
        return pd.DataFrame({"id": one["id"][mine], "near": near})[near >= threshold]

    found = sent.groupBy("tile", "lot").cogroup(placed.groupBy("t", "l")).applyInPandas(best, f"id {kind}, near double")
    return found.groupBy("id").agg(F.max("near").alias("near"))
