"""Ranked lexical search over an index of quadtrees with impact maxima.

``index`` cuts the documents into blocks. A block is a grid with a row for each of its terms and a column for each of its documents, in the order of
their ids; what a term adds to a document's score, but for the term's weight, is the value at their place, and a ``Treap`` holds the grid.
``search`` takes an item's terms down their rows together: a state is a range of documents with the cell of every term over it, its
bound the sum of weights times maxima. The states of the highest bounds are halved first, until no bound reaches the results at hand.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillrisk.llm._packed import flat, pack, unpack
from quillrisk.llm._tokens import SLICE_BYTES, Words, slices
from quillrisk.llm._treap import Treap

#: A term is a run of ASCII letters, digits and bytes beyond ASCII.
BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Bytes of text in a block of the index.
BLOCK_BYTES = 8 * SLICE_BYTES
#: States of an item that are halved at a time.
WIDTH = 24
#: Bytes of items that are searched in one pass; more items take more passes.
PASS_BYTES = 1 << 24
UNIT = 10**9


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeStringArray:
    """The stretches of ``data`` as strings."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[at]))


def counts(w: Words) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``(terms, term, text, times)``: the distinct terms of some texts, the most widespread first, and how often each text holds each of its own."""
    _, first, term = np.unique(w.hashes(), return_index=True, return_inverse=True)
    both, times = np.unique(w.text_of * max(1, len(first)) + term, return_counts=True)
    text, term = np.divmod(both, max(1, len(first)))
    order = np.argsort(-np.bincount(term, minlength=len(first)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return strings(w.data, w.starts[first[order]], w.ends[first[order]]), place[term], text, times


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """``(documents with a term, terms of all documents)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2, np.int64)
        for batch in batches:
            for w in slices(batch.column(0), breaks=BREAKS):
                n += [np.count_nonzero(w.counts), len(w.starts)]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in n], ["docs", "terms"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "docs long, terms long")
    row = found.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    return int(row["docs"]), int(row["terms"])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(n_docs, n_terms, ids, terms, held, height, bits, drops)``, a row for a block of documents; write it to search it again and again.

    ``held`` counts the block's documents that hold each of its ``terms``. Two passes over the texts and no shuffle: totals of the whole corpus come
    first, since a value depends on them. Texts that are null or without terms are in no block, null ids come last, repeated rows are documents of
    their own, other columns are not read, an empty table gives an empty index. A text of any length lies in one block.
    """
    n_docs, n_terms = totals(docs, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = pc.sort_indices(batch.column(0), null_placement="at_end")
            ids, texts = batch.column(0).take(order), batch.column(1).take(order)
            for w in slices(texts, lower=True, max_bytes=block_bytes, breaks=BREAKS):
                mine = np.flatnonzero(w.counts)
                if not len(mine):
                    continue
                terms, term, text, times = counts(w)
                column = np.zeros(len(w.counts), np.int64)
                column[mine] = np.arange(len(mine))
                m = 75 + (25 * w.counts[text] * n_docs) // n_terms
                value = (UNIT * times) // (1000 * times + 12 * m)
                some = value > 0
                if not some.any():
                    continue
                height, bits, drops = Treap.build(term[some], column[text[some]], value[some])
                held = pack(np.bincount(term, minlength=len(terms)))
                out = {"n_docs": n_docs, "n_terms": n_terms, "ids": ids.take(pa.array(mine + w.row)), "terms": terms.cast(pa.string()), "held": held, "height": height, "bits": bits, "drops": drops}
                listed = {k: pa.ListArray.from_arrays([0, len(v)], v) if isinstance(v, pa.Array) else pa.array([v]) for k, v in out.items()}
                yield pa.RecordBatch.from_pydict(listed)

    return rows.mapInArrow(blocks, f"n_docs long, n_terms long, ids array<{kind}>, terms array<string>, held binary, height long, bits binary, drops binary")


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, id, size, terms)``: a number for each row, its id and its terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for w in slices(batch.column(2), lower=True, breaks=BREAKS):
                words = strings(w.data, w.starts, w.ends).to_pylist()
                for i in range(len(w.counts)):
                    found[w.row + i] = words[w.first[i] : w.first[i + 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["item", "id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"item long, id {rows.schema['id'].dataType.simpleString()}, terms array<string>")


def document_counts(indexed: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many documents each of ``terms`` is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.string())
        for batch in batches:
            n = np.zeros(len(terms), np.int64)
            for own, held in zip(batch.column(0), batch.column(1)):
                at = pc.index_in(wanted, own.values).to_numpy(zero_copy_only=False)
                known = ~np.isnan(at.astype(float))
                n[known] += unpack(held.as_py())[at[known].astype(np.int64)]
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["term", "n"])

    rows = indexed.select("terms", "held").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {terms[r["term"]]: r["n"] for r in rows}


class Tops:
    """The best results of every item at hand: score, then place in the order of ids. ``place`` is in halves, so that results of other blocks fit between."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.item, self.score, self.place, self.block = (np.zeros(0, np.int64) for _ in range(4))
        self.ids: list = []
        self.limits()

    def limits(self) -> None:
        """What a bound has to reach: the last result's score and place, or any score while results are few."""
        self.least, self.last = np.ones(self.n, np.int64), np.full(self.n, np.iinfo(np.int64).max)
        full = np.flatnonzero(np.bincount(self.item, minlength=self.n) == self.k)
        at = np.searchsorted(self.item, full, side="right") - 1
        self.least[full], self.last[full] = self.score[at], self.place[at]

    def add(self, item: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        """Places of the block at hand."""
        item, score, place = np.r_[self.item, item], np.r_[self.score, score], np.r_[self.place, place]
        block = np.r_[self.block, np.full(len(item) - len(self.block), -1)]
        order = np.lexsort((place, -score, item))
        rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order = order[rank < self.k]
        self.item, self.score, self.place, self.block = item[order], score[order], place[order], block[order]
        self.limits()

    def enter(self, ids: list) -> None:
        """A block with these ids, in order, nulls last: places of what other blocks gave."""
        some = len(ids) - ids.count(None)
        where = [2 * (len(ids) if self.ids[b] is None else bisect_left(ids, self.ids[b], 0, some)) - 1 for b in self.block]
        self.place = np.array(where, np.int64)
        order = np.lexsort((self.place, -self.score, self.item))
        self.item, self.score, self.place, self.block = (x[order] for x in (self.item, self.score, self.place, self.block))
        self.limits()

    def leave(self, ids: list) -> None:
        kept = [self.ids[b] if b >= 0 else ids[p >> 1] for b, p in zip(self.block, self.place)]
        self.ids, self.block = kept, np.arange(len(kept))


def descend(grid: Treap, item: np.ndarray, row: np.ndarray, weight: np.ndarray, tops: Tops, width: int = WIDTH) -> int:
    """Put the best documents of a block into ``tops``; how many states were halved. ``item, row, weight``: the terms of every item, ordered by item."""
    items, first, size = np.unique(item, return_index=True, return_counts=True)
    state = {"item": items, "bound": np.add.reduceat(weight * grid.most[0], first), "column": np.zeros(len(items), np.int64), "level": np.zeros(len(items), np.int64), "size": size}
    cell, term, halved = np.zeros(len(row), np.int64), np.arange(len(row)), 0
    while True:
        start = state["column"] << (grid.height - state["level"])
        least = tops.least[state["item"]]
        live = (state["bound"] > least) | ((state["bound"] == least) & (2 * start <= tops.last[state["item"]]))
        first = np.cumsum(state["size"]) - state["size"]
        if not live.all():
            at = flat(first[live], state["size"][live])
            cell, term, state = cell[at], term[at], {k: v[live] for k, v in state.items()}
            first = np.cumsum(state["size"]) - state["size"]
        if not len(state["item"]):
            return halved
        order = np.lexsort((state["column"], -state["bound"], state["item"]))
        rank = np.arange(len(order)) - np.searchsorted(state["item"][order], state["item"][order])
        best = np.zeros(len(order), bool)
        best[order[rank < width]] = True
        halved += int(best.sum())
        at, size = flat(first[best], state["size"][best]), state["size"][best]
        of, level = np.repeat(np.arange(len(size)), size), np.repeat(state["level"][best], size)
        below = 2 * ((row[term[at]] >> (grid.height - 1 - level)) & 1)
        new, cells, terms = [], [], []
        for half in (0, 1):
            child = grid.down(cell[at], below + half)
            there = np.flatnonzero(child)
            part = np.bincount(of[there], minlength=len(size))
            bound = np.zeros(len(size), np.int64)
            np.add.at(bound, of[there], weight[term[at[there]]] * grid.most[child[there]])
            some = part > 0
            new.append({"item": state["item"][best][some], "bound": bound[some], "column": 2 * state["column"][best][some] + half, "level": state["level"][best][some] + 1, "size": part[some]})
            cells.append(child[there])
            terms.append(term[at[there]])
        rest = ~best
        at = flat(first[rest], state["size"][rest])
        state = {k: np.concatenate([v[rest], *[x[k] for x in new]]) for k, v in state.items()}
        cell, term = np.concatenate([cell[at], *cells]), np.concatenate([term[at], *terms])
        done = state["level"] == grid.height
        if done.any():
            found = {k: v[done] for k, v in state.items()}
            good = found["bound"] >= tops.least[found["item"]]
            if good.any():
                tops.add(found["item"][good], found["bound"][good], 2 * found["column"][good])
            at = flat((np.cumsum(state["size"]) - state["size"])[~done], state["size"][~done])
            cell, term, state = cell[at], term[at], {k: v[~done] for k, v in state.items()}


def search(indexed: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 20, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every row of ``items``, equal scores by ascending id, nulls last.

    Items are the stated queries: those of a pass (``pass_bytes`` of text at most, by hash, and a longer item alone) go to every task; more items
    take more passes over the index. A task carries its results from block to block, so most blocks end after a few states, and gives at most ``k``
    rows for each item. Items that are null, without terms or without documents have no rows; an item id that comes twice has the rows of both.
    """
    read = item_terms(items, id_col, text_col)
    size = items.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    passes = max(1, math.ceil(size / pass_bytes))
    kind, own = indexed.schema["ids"].dataType.elementType.simpleString(), read.schema["id"].dataType.simpleString()
    found = [_one_pass(indexed, read.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p) if passes > 1 else read, kind, own, k) for p in range(passes)]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _one_pass(indexed: DataFrame, read: DataFrame, kind: str, own: str, k: int) -> DataFrame:
    rows = read.collect()
    names, times = sorted({t for r in rows for t in r["terms"]}), []
    place = {t: i for i, t in enumerate(names)}
    for i, r in enumerate(rows):
        of: dict[int, int] = {}
        for t in r["terms"]:
            of[place[t]] = of.get(place[t], 0) + 1
        times += [(i, t, n) for t, n in of.items()]
    held = document_counts(indexed, names) if names else {}
    n_docs = indexed.select("n_docs").first()
    n_docs = n_docs[0] if n_docs else 0
    weigh = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(t, 0) + 1))) for t in names], np.int64)
    item, term, often = (np.array(x, np.int64) for x in (zip(*times) if times else ([], [], [])))
    numbers, ids = [r["item"] for r in rows], [r["id"] for r in rows]
    schema = T._parse_datatype_string(f"item long, item_id {own}, doc_id {kind}, score long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, tops, id_type = pa.array(names, pa.string()), Tops(len(numbers), k), None
        for batch in batches:
            for i in range(batch.num_rows):
                own_terms, doc_ids = batch.column("terms")[i].values, batch.column("ids")[i].values
                id_type = doc_ids.type
                at = pc.fill_null(pc.index_in(wanted, own_terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                mine = np.flatnonzero((at[term] >= 0) & (weigh[term] > 0)) if len(term) else term
                if not len(mine):
                    continue
                listed = doc_ids.to_pylist()
                tops.enter(listed)
                grid = Treap.load(batch.column("height")[i].as_py(), batch.column("bits")[i].as_py(), batch.column("drops")[i].as_py())
                descend(grid, item[mine], at[term[mine]], weigh[term[mine]] * often[mine], tops)
                tops.leave(listed)
        if len(tops.item):
            own_ids = pa.array([ids[i] for i in tops.item], type=_arrow(schema["item_id"].dataType))
            yield pa.RecordBatch.from_arrays([pa.array([numbers[i] for i in tops.item], pa.int64()), own_ids, pa.array(tops.ids, id_type), pa.array(tops.score)], ["item", "item_id", "doc_id", "score"])

    return indexed.select("ids", "terms", "height", "bits", "drops").mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
