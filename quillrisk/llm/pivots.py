"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Vectors that share at least
``shared`` of their first ``depth`` pivots are candidates: the inverted lists are kept per combination of ``shared`` pivots, so that
everything that meets in a list has the count already. Lists longer than a tile are cut into tiles and every
pair of tiles is compared. Candidates are verified by cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrisk.llm.components import components
from quillrisk.session import durable

TILE = 1024


def _vectors(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _usable(rows: DataFrame, dim: int) -> DataFrame:
    """Unit vectors; null, zero, non-finite and odd-sized ones go, as none of them links with anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            fit = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
            x = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # null components: NaN
            scale = np.abs(x).max(axis=1, initial=0)
            good = np.isfinite(scale) & (scale > 0)
            x = x[good] / scale[good][:, None]  # keeps squares from running over or under
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fit[good])), _lists(x + 0.0)], ["id", "unit"])

    return rows.mapInArrow(run, "id long, unit array<double>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def choose_pivots(units: DataFrame, pivots: int, sample: int, apart: float) -> np.ndarray:
    """At most ``pivots`` vectors out of ``sample`` (least hashes of ids), no two with a cosine above ``apart``."""
    x = _vectors(units.orderBy(F.xxhash64("id"), "id").limit(sample).select("unit").toArrow()["unit"].combine_chunks())
    chosen: list[int] = []
    for i in range(len(x)):
        if len(chosen) < pivots and (not chosen or (x[chosen] @ x[i]).max() <= apart):
            chosen.append(i)
    return x[chosen]


def _keys(order: np.ndarray, shared: int, n_pivots: int) -> np.ndarray:
    """One number for every combination of ``shared`` pivots of each row's sorted pivots."""
    keys = []
    for c in combinations(range(order.shape[1]), shared):
        key = np.zeros(len(order), np.int64)
        for j in c:
            key = key * n_pivots + order[:, j]
        keys.append(key)
    return np.stack(keys, axis=1)


def _count(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, key: int, same: bool, threshold: float, shared: int, n_pivots: int):
    """Links of two tiles as index pairs, and which of them are counted in the list of ``key``: each link is in one."""
    a, b = np.nonzero(np.clip(x @ y.T, -1, 1) >= threshold)
    if same:
        a, b = a[a < b], b[a < b]
    both = (px[a][:, :, None] == py[b][:, None, :]).any(axis=2)
    rank = np.cumsum(both, axis=1)
    first = both & (rank <= shared)
    least = np.zeros(len(a), np.int64)
    for j in range(px.shape[1]):
        least = np.where(first[:, j], least * n_pivots + px[a][:, j], least)
    return a, b, least == key


def pivots_for(n: int, least: int = 256) -> int:
    """How many pivots ``n`` distinct vectors take: with so many, lists of pairs of pivots stay as long as they are for fewer vectors."""
    return max(least, math.ceil(math.sqrt(n) / 4))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    pivots: int | None = None,
    depth: int = 5,
    shared: int = 2,
    sample: int = 4096,
    apart: float = 0.6,
    tile: int = TILE,
) -> DataFrame:
    """``(id, n_links, component_id)`` for every row.

    Links are pairs found in the index with a cosine of at least ``threshold``. The most common vector length counts as
    the dimension; other lengths, null and zero vectors, null and non-finite components link with nothing. Rows
    of a null or repeated id are vectors of their own: they get equal results by id, links to rows of the
    same id are counted. Equal unit vectors are indexed once, with their number, so that a large group of copies is one entry. All rows are indexed; the
    pivots (as many as ``pivots_for`` says, unless given) are chosen from a bounded ``sample``.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sizes = rows.where("vector IS NOT NULL").groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    top = sizes.where("d > 0").orderBy(F.desc("n"), "d").first()
    none = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if top is None:
        return none
    units = durable(_usable(rows.where("id IS NOT NULL"), top["d"]).withColumn("mark", F.md5(F.concat_ws(",", F.col("unit").cast("array<string>")))), "unit-vectors")
    # Equal vectors are one entry under their least id. A double's text is exact, so that one mark is one vector.
    entries = durable(units.groupBy("mark").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("unit").alias("unit")), "vectors")
    wanted = pivots or pivots_for(entries.count())
    centre = choose_pivots(entries, wanted, max(sample, 2 * wanted), apart)
    if not len(centre):
        return none
    n_pivots, depth = len(centre), min(depth, len(centre))
    shared = min(shared, depth)
    sent = vectors.sparkSession.sparkContext.broadcast(centre)  # pivots x dimension

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _vectors(batch.column(1)) @ sent.value.T
            order = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :depth], axis=1).astype(np.int64)
            keys = _keys(order, shared, n_pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(order), _lists(keys)], ["id", "unit", "copies", "mark", "pivots", "keys"])

    described = entries.select("id", "unit", "copies", "mark").mapInArrow(index, "id long, unit array<double>, copies long, mark string, pivots array<long>, keys array<long>")
    described = durable(described.withColumn("row", F.monotonically_increasing_id()), "pivot-lists")
    lists = described.select("row", F.explode("keys").alias("key"))
    lengths = lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    cuts = lengths.select("key", F.ceil(F.col("n") / tile).cast("int").alias("cuts"))
    placed = lists.join(cuts, "key").withColumn("own", F.pmod(F.xxhash64("row"), F.col("cuts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")
    tiles = placed.select("row", "key", "own", other)
    tiles = tiles.select("row", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")
    members = tiles.join(described.select("row", "id", "copies", "unit", "pivots"), "row")
    # A tile pair holds some two tiles of rows, however long its list is.
    grouped = members.groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("row", "id", "own", "copies", "unit", "pivots")).alias("m")).where(F.size("m") > 1)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            keys, los, his = (batch.column(k).to_numpy() for k in range(3))
            m = batch.column(3)
            flat, offsets = m.flatten(), m.offsets.to_numpy() - m.offsets[0].as_py()
            row, id_, own, copies = (flat.field(k).to_numpy() for k in ("row", "id", "own", "copies"))
            unit, order = _vectors(flat.field("unit")), _vectors(flat.field("pivots"))
            for g in range(len(m)):
                i = np.arange(offsets[g], offsets[g + 1])
                same = los[g] == his[g]
                x, y = (i, i) if same else (i[own[i] == los[g]], i[own[i] == his[g]])
                a, b, mine = _count(unit[x], unit[y], order[x], order[y], keys[g], same, threshold, shared, n_pivots)
                if not len(a):
                    continue
                u, v = x[a[mine]], y[b[mine]]
                n = np.bincount(np.concatenate([u, v]) - offsets[g], np.concatenate([copies[v], copies[u]]), len(i)).astype(np.int64)
                root = _roots(id_[i], x[a] - offsets[g], y[b] - offsets[g])
                live = (n > 0) | (root != id_[i])
                parts.append((row[i][live], id_[i][live], n[live], root[live]))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["row", "id", "n", "root"])

    found = durable(grouped.mapInArrow(verify, "row long, id long, n long, root long"), "pivot-links")
    near = found.groupBy("row").agg(F.sum("n").alias("n"))
    counts = described.select("row", "mark", "copies").join(near, "row", "left").select("mark", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"))
    named = units.select("id", "mark").join(entries.select("mark", F.col("id").alias("least")), "mark")
    links = units.select("id", "mark").join(counts, "mark").groupBy("id").agg(F.max("n").alias("n_links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(named.select("id", "least")))
    out = rows.select("id").join(links, "id", "left").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))


def _roots(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least id that each member reaches over the links ``a, b`` of a tile pair."""
    root = ids.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            return root
        root = new
