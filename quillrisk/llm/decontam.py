"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some places of a run of words and ignores the others, so a changed word in an ignored place
does not change the hash. Documents and benchmark items that share a hash of some mask are lined up at
that place, and the words around it are compared one by one, changed words allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrisk.llm._bits import bit_set, in_bits
from quillrisk.llm._rows import column, free_name, row_key
from quillrisk.llm._tokens import SPACE, Words, mix, slices
from quillrisk.session import durable

#: Kept (1) and ignored (0) places. Five words in line of which at most one is changed have a hit of one of them. An overlap
#: without a hit has two changes or more in any five words, which is more than either rule below lets pass: a share of
#: 0.8 allows one in five, and a stretch whose sum (+1 a match, -2 a change) keeps rising has fewer than one in three.
MASKS = ("1111", "11011", "10111", "11101")
#: Items of fewer words are too short to tell a quotation from chance, unless they are the whole document.
MIN_ITEM_WORDS = 5

#: White space and ASCII punctuation part words here.
_BREAKS = SPACE.copy()
_BREAKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SCALE = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _masks() -> list[tuple[int, ...]]:
    """Kept places of each mask."""
    return [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS]


def _seeds(w: Words, masks: list[tuple[int, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per mask, then for short texts: hashes, places of their first words, and the words' hashes."""
    h, text_of = w.hashes(), w.text_of
    for k, places in enumerate(masks):
        n = len(h) - places[-1]
        if n <= 0:
            continue
        total = np.full(n, k + 1, np.uint64)
        for j, p in enumerate(places):
            total += h[p : p + n] * _SCALE[j]
        at = np.flatnonzero(text_of[:n] == text_of[places[-1] :])
        yield mix(total[at]), at, h
    short = np.flatnonzero((w.counts > 0) & (w.counts < MIN_ITEM_WORDS))  # all words of a short text at once
    if len(short):
        first, size = w.first[short], w.counts[short]
        total = size.astype(np.uint64) * _SCALE[-1]
        for j in range(MIN_ITEM_WORDS - 1):
            total += np.where(j < size, h[np.minimum(first + j, len(h) - 1)] * _SCALE[j], np.uint64(0))
        yield mix(total), first, h


def _codes(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _items(benchmark: DataFrame) -> DataFrame:
    """``(item, h, place)``: seeds of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(1), True, breaks=_BREAKS):
                for seeds, at, h in _seeds(w, _masks()):
                    text = np.searchsorted(w.first, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(w.row + text)), pa.array(seeds.view(np.int64)), pa.array((at - w.first[text]).astype(np.int32))],
                        ["item", "h", "place"],
                    )

    return benchmark.mapInArrow(run, f"item {benchmark.schema['item'].dataType.simpleString()}, h long, place int")


def _item_words(benchmark: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list[np.ndarray] = []
            for w in slices(batch.column(1), True, breaks=_BREAKS):
                codes += np.split(_codes(w.hashes()), w.first[1:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int32()))], ["item", "item_words"])

    return benchmark.mapInArrow(run, f"item {benchmark.schema['item'].dataType.simpleString()}, item_words array<int>")


def _best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and matches of the stretch with the best sum of +1 a match and -2 a change."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    start = int(np.argmin(sums[: end + 1]))
    return start, end, int(same[start:end].sum())


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``(row, id, item, start, words, matches, aligned, doc_size, item_size)``: verified overlaps of documents and items.

    ``row`` tells rows by id and text; ``start`` and ``words`` are the best stretch in words of the document, with ``matches``
    equal words; ``aligned`` are the equal words of the whole item where it lies. Items of equal text are tested once,
    under the smallest id.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_text_col).isNotNull() & F.col(item_col).isNotNull())
    items = items.groupBy(F.col(item_text_col).cast("string").alias("text")).agg(F.min(item_col).alias("item")).select("item", "text")
    texts = durable(_item_words(items).join(items, "item").withColumn("item_size", F.size("item_words")).where("item_size > 0"), "items")
    seeds = durable(_items(texts.select("item", "text")), "item-seeds")
    known = spark.sparkContext.broadcast(bit_set(seeds.select("h").distinct(), spare=12))
    masks = _masks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hits, places, codes = [], [], [], []
            for w in slices(batch.column(2), True, breaks=_BREAKS):
                found = [(s[hit], at[hit], h) for s, at, h in _seeds(w, masks) if (hit := in_bits(s, known.value)).any()]
                if not found:
                    continue
                s, at = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                text = np.searchsorted(w.first, at, side="right") - 1
                for t in np.unique(text):
                    mine = text == t
                    rows.append(w.row + int(t))
                    hits.append(s[mine].view(np.int64))
                    places.append((at[mine] - w.first[t]).astype(np.int32))
                    codes.append(_codes(found[0][2][w.first[t] : w.first[t + 1]]))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                    pa.array(hits, pa.list_(pa.int64())),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array(codes, pa.list_(pa.int32())),
                ],
                ["row", "id", "hits", "places", "doc_words"],
            )

    source = docs.select(row_key(docs, id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    met = source.mapInArrow(run, f"row string, id {kind}, hits array<long>, places array<int>, doc_words array<int>")
    met = durable(met.dropDuplicates(["row"]), "seed-hits")
    at = met.select("row", F.explode(F.arrays_zip("hits", "places")).alias("at")).select("row", F.col("at.hits").alias("h"), F.col("at.places").alias("doc_place"))
    lines = at.join(seeds, "h").select("row", "item", (F.col("doc_place") - F.col("place")).alias("shift")).distinct()
    pairs = lines.join(texts.select("item", "item_words", "item_size"), "item").join(met.select("row", "id", "doc_words"), "row")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shift, ours, theirs = batch.column("shift").to_numpy(), batch.column("doc_words"), batch.column("item_words")
            out = []
            for i, s in enumerate(shift.tolist()):
                d, t = ours[i].values.to_numpy(), theirs[i].values.to_numpy()
                lo, hi = max(0, s), min(len(d), s + len(t))
                same = d[lo:hi] == t[lo - s : hi - s]
                a, b, n = _best_stretch(same)
                out.append((lo + a, b - a, n, int(same.sum()), len(d)))
            found = [pa.array(c, pa.int32()) for c in zip(*out)] if out else [pa.array([], pa.int32())] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("item"), *found, batch.column("item_size")],
                ["row", "id", "item", "start", "words", "matches", "aligned", "doc_size", "item_size"],
            )

    item_kind = texts.schema["item"].dataType.simpleString()
    return pairs.mapInArrow(verify, f"row string, id {kind}, item {item_kind}, start int, words int, matches int, aligned int, doc_size int, item_size int")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_matches: int = 13,
    min_share: float = 0.8,
) -> DataFrame:
    """``(id, contaminated, items, longest)`` for every row.

    A document is contaminated by an item if an aligned stretch has ``min_matches`` equal words, or if ``min_share`` of
    the item's words are equal where it lies; none is missed for a share of 0.8 or more. An item of fewer than five words contaminates the
    documents that consist of it. ``items``: their ids, sorted; ``longest``: most equal words in a stretch. Null and empty texts
    are clean, as is everything against an empty benchmark; null items and items without words are not
    tested. Repeated rows get equal results; extra columns are ignored.
    """
    found = _contaminating(overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col), min_matches, min_share)
    found = found.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("matches").alias("longest"))
    rows = docs.select(F.col(id_col).alias("id"), row_key(docs, id_col, text_col).alias("row")).join(found, "row", "left")
    none = F.array().cast(found.schema["items"].dataType)
    return rows.select("id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("items"), F.coalesce("longest", F.lit(0)).alias("longest"))


def _contaminating(found: DataFrame, min_matches: int, min_share: float) -> DataFrame:
    whole = (F.col("aligned") == F.col("item_size")) & (F.col("doc_size") == F.col("item_size"))
    long = (F.col("matches") >= min_matches) | (F.col("aligned") >= F.col("item_size") * min_share)
    return found.where(F.when(F.col("item_size") < MIN_ITEM_WORDS, whole).otherwise(long))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_matches: int = 13, min_share: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns, none of which is touched."""
    key = free_name(docs, "row")
    found = _contaminating(overlaps(docs, benchmark, id_col, text_col), min_matches, min_share).select(F.col("row").alias(key)).distinct()
    return docs.withColumn(key, row_key(docs, id_col, text_col)).join(found, key, "left_anti").select(*map(column, docs.columns))
