"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits share a variant that is within ``radius / 2``
of both. Every fingerprint goes to the variants within that half radius; fingerprints that meet in a
variant are linked. The shuffle is on the leading bits of the variants: a fingerprint is sent once to each
leading part that its variants have, and the task that holds a part writes out the rest of the
variants, so that 37 short rows travel in place of 2,081 (64 bits, radius 4, 8 leading bits).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrisk.llm._rows import column, free_name, row_key
from quillrisk.llm._tokens import SPACE, slices
from quillrisk.llm.components import components, local_roots
from quillrisk.session import durable

BITS = 64
#: Variants that a task writes out for one leading part, about; sets the number of leading bits.
PART_VARIANTS = 2_000_000


def _fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    """Fingerprints of whole texts; lower-cases A-Z only."""
    out = np.zeros(len(texts), np.uint64)
    for w in slices(texts, lower=True):
        n = len(w.first) - 1
        if not len(w.starts):
            continue
        space = SPACE[w.data]
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        line = np.where(space, np.uint8(32), w.data)[keep].tobytes()
        moved = np.cumsum(keep) - 1
        starts, ends = moved[w.starts], moved[w.ends - 1] + 1
        # A break between texts without white space keeps no space; slices never cross texts.
        size = np.where(w.counts >= shingle, w.counts - shingle + 1, np.minimum(w.counts, 1))
        rows = np.flatnonzero(size)
        begin = np.concatenate([[0], np.cumsum(size[rows])])
        index = np.arange(begin[-1]) + np.repeat(w.first[rows] - begin[:-1], size[rows])
        last = np.minimum(index + shingle - 1, np.repeat(w.first[rows + 1] - 1, size[rows]))
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[index].tolist(), ends[last].tolist())), np.uint64, len(index))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, begin[:-1], axis=0, dtype=np.int32)
        over = 2 * ones > size[rows][:, None]
        out[w.row + rows] = np.packbits(over, axis=1).view(">u8").ravel()
        assert n >= len(rows)
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, fp)``, a row for each row: XXH64 (seed 42) of word shingles, majority of each bit.

    Null, empty and blank texts have fingerprint 0; texts of fewer words than a shingle are one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _fingerprints(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _masks(width: int, most: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``most`` bits set."""
    out = [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(width), k)]
    return np.array(out, np.uint64)


def _meet(fps: np.ndarray, lead: int, lead_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among ``fps`` through variants whose leading bits are ``lead``, as (fingerprint, root)."""
    fps = np.unique(fps)
    low_bits = BITS - lead_bits
    top = (fps >> np.uint64(low_bits)) if lead_bits else np.zeros(len(fps), np.uint64)
    flips = np.bitwise_count(top ^ np.uint64(lead))
    rest = fps & np.uint64((1 << low_bits) - 1)
    parts, owners = [], []
    for k in range(radius // 2 + 1):
        mine = np.flatnonzero(flips == k)
        masks = _masks(low_bits, radius // 2 - k)
        parts.append((rest[mine][:, None] ^ masks[None, :]).ravel())
        owners.append((mine, len(masks)))
    variants = np.concatenate(parts)
    ordered = np.sort(variants)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(shared):
        return fps[:0], fps[:0]
    at = np.searchsorted(shared, variants)
    met = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == variants)
    owner = np.concatenate([np.repeat(mine.astype(np.int32), m) for mine, m in owners])[met]
    order = np.lexsort((owner, at[met]))
    group, owner = at[met][order], owner[order]
    head = np.r_[True, group[1:] != group[:-1]]
    first = owner[np.flatnonzero(head)[np.cumsum(head) - 1]]
    near = np.bitwise_count(fps[first] ^ fps[owner]) <= radius
    links = np.unique(np.stack([first[near & ~head], owner[near & ~head]]), axis=1)
    root = local_roots(len(fps), links[0], links[1])
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def ball_links(fps: DataFrame, radius: int = 4, part_variants: int = PART_VARIANTS) -> DataFrame:
    """``(a, b)``: links that connect the same fingerprints (column ``fp``, distinct) as all pairs within ``radius``.

    Fingerprints that meet in a variant are all within ``radius`` of each other, so each task links
    them to one of their number instead of writing all pairs; which fingerprints reach each other is the same.
    """
    half = radius // 2
    ball = sum(math.comb(BITS, k) for k in range(half + 1))
    lead_bits = min(32, max(2, math.ceil(math.log2(max(1, fps.count()) * ball / part_variants + 1))))
    shift = BITS - lead_bits

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = _meet(rows.column("fp").to_numpy().view(np.uint64), key[0].as_py(), lead_bits, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    masks = F.array(*[F.lit(int(m)) for m in _masks(lead_bits, half)]).cast("array<bigint>")
    lead = F.shiftrightunsigned("fp", shift)
    parts = fps.select("fp", F.explode(masks).alias("mask")).select("fp", lead.bitwiseXOR(F.col("mask")).alias("lead"))
    return parts.groupBy("lead").applyInArrow(run, "a long, b long")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """``(id, fp)`` of every row, and ``(fp, component_id)`` of every fingerprint."""
    marked = durable(fingerprint(docs, id_col, text_col, shingle), "fingerprints")
    classes = durable(marked.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    roots = components(ball_links(classes.select("fp"), radius))
    linked = classes.join(roots, classes.fp == roots.node)
    least = linked.groupBy("root").agg(F.min("first_id").alias("least"))
    named = linked.join(least, "root").select("fp", "least")
    return marked, classes.join(named, "fp", "left").select("fp", F.coalesce("least", "first_id").alias("component_id"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """``(id, fp, component_id)`` for every row: the smallest id reachable over links of ``radius`` bits.

    Rows of one fingerprint are linked; repeated rows are returned as often as they come. A null id
    is returned with its class, but never names it unless the class has no other id. Extra columns are ignored.
    """
    marked, named = _classes(docs, id_col, text_col, shingle, radius)
    return marked.join(named, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of each class of near-duplicates, with all its columns: that of the smallest id, null ids last.

    Rows are told apart by all their columns, so that different rows of one id are different documents; of rows that are
    equal in everything one stays. No column of ``docs`` is touched, whatever its name.
    """
    digest = free_name(docs, "digest")
    keyed = docs.withColumn(digest, row_key(docs))
    key = F.struct(column(id_col).isNull().alias("none"), column(id_col).alias("id"), F.col(digest).alias("digest"))
    _, named = _classes(keyed.select(key.alias("key"), column(text_col).alias("text")), "key", "text", shingle, radius)
    kept = named.select(F.col("component_id.digest").alias(digest)).distinct()
    return keyed.join(kept, digest, "left_semi").dropDuplicates([digest]).select(*map(column, docs.columns))
