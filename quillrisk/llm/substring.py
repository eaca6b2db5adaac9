"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the ``span - seed + 1`` runs of ``seed`` words in every window of ``span`` words, the one with the
least hash. Equal windows have equal anchors at the same offset, so places of an anchor are joined with its first place, and the match is
extended from the anchor to the left and to the right, word code by word code; windows inside the match are repeats. Windows
that differ from those at the first place are compared with one another, below their anchor and offset. Repeated windows that overlap
are merged into maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrisk.llm._bits import bit_set, in_bits
from quillrisk.llm._tokens import Words, _powers_to, mix, slices
from quillrisk.session import durable

#: Window starts that are handled at a time; a place in a block fits the low 24 bits of a key.
BLOCK = 1 << 20
_LOW = np.uint64((1 << 24) - 1)
_NO_ID = (1 << 63) - 1
_SCALE = np.random.default_rng(11).integers(1, 1 << 63, 128, dtype=np.uint64) | np.uint64(1)


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive word hashes."""
    power, inverse = _powers_to(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], dtype=np.uint64, out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * inverse[: len(h) - length + 1])


def _anchors(w: Words, span: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: first words of windows, their anchors' hashes and places, and the words' hashes."""
    hashes, text_of = w.hashes(), w.text_of
    for at in range(0, max(0, len(hashes) - span + 1), BLOCK):
        h = hashes[at : at + BLOCK + span - 1]
        grams = _runs(h, seed)
        key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        width, wide = span - seed + 1, 1
        while wide * 2 <= width:
            key = np.minimum(key[:-wide], key[wide:])
            wide *= 2
        if wide < width:
            key = np.minimum(key[: len(key) - (width - wide)], key[width - wide :])
        start = np.arange(at, at + len(key))
        inside = text_of[start] == text_of[start + span - 1]
        place = (key & _LOW).astype(np.int64)
        yield start[inside], grams[place[inside]], at + place[inside], hashes


def anchor_counts(texts: DataFrame, span: int, seed: int) -> DataFrame:
    """``(h, n)``: anchors and the number of places where they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(1)):
                for _, h, place, _ in _anchors(w, span, seed):
                    new = np.r_[True, place[1:] != place[:-1]] if len(place) else np.zeros(0, bool)
                    keys, n = np.unique(h[new], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _stretches(doc: np.ndarray, start: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (sorted by text and start) merged into stretches: the index of their first window, start and length."""
    if not len(start):
        return start, start, start
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + span)]
    head = np.flatnonzero(new)
    last = np.r_[head[1:], len(start)] - 1
    return head, start[head], start[last] + span - start[head]


def _offsets(mask: np.ndarray, width: int) -> np.ndarray:
    return (mask[:, None] >> np.arange(width)) & 1 == 1


def _code(h: np.ndarray) -> np.ndarray:
    """32 bits of a hash, never 0."""
    return np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)


def _rows(start: np.ndarray, place: np.ndarray, h: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, ...]:
    """Places of anchors of the windows ``start`` (rising): index of one of its windows, offsets of its windows as bits, and its context.

    The context has the codes of the words before the anchor, nearest first, those after it, and one for the anchor
    itself; words that none of the windows holds are 0.
    """
    width = span - seed + 1
    head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(start) else start
    last = np.r_[head[1:], len(start)] - 1 if len(head) else head
    mask = np.bitwise_or.reduceat(1 << (place - start), head) if len(head) else head
    p, before = place[head], (place - start)[head]  # the first window reaches back most
    after = width - 1 - (place - start)[last]
    j = np.arange(width - 1)
    code = lambda i: _code(h[np.clip(i, 0, len(h) - 1)])
    left = np.where(j < before[:, None], code(p[:, None] - 1 - j), 0)
    right = np.where(j < after[:, None], code(p[:, None] + seed + j), 0)
    own = np.zeros(len(p), np.uint64)
    for i in range(seed):
        own += h[p + i] * _SCALE[i]
    return head, mask, np.concatenate([left, right, _code(mix(own))[:, None]], axis=1).astype(np.uint32)


def _occurrences(texts: DataFrame, shared, span: int, seed: int, anchor_bits: int) -> DataFrame:
    """Places of anchors that may occur more than once ``(h, id, place, mask, context)``, and stretches that are repeats within a
    slice, which need no join ``(id, place: where it begins, length)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for w in slices(batch.column(1), max_bytes=2 << 20):
                for start, anchor, place, hashes in _anchors(w, span, seed):
                    keep = in_bits(anchor, shared.value)
                    start, anchor, place = start[keep], anchor[keep], place[keep]
                    if not len(start):
                        continue
                    h = _runs(hashes[start[0] : start[-1] + span], span)[start - start[0]]
                    text = np.searchsorted(w.first, start, side="right") - 1
                    own, doc = start - w.first[text], ids[w.row + text]
                    order = np.lexsort((own, doc, h))
                    one, two = order[:-1], order[1:]
                    again, same = np.zeros(len(order), bool), np.zeros(len(order), bool)
                    again[two] = h[two] == h[one]
                    for i in range(span):  # the words themselves
                        again[two] &= hashes[start[two] + i] == hashes[start[one] + i]
                    same[two] = again[two] & (doc[two] == doc[one]) & (own[two] == own[one])  # the same place of an id that comes twice
                    again &= ~same
                    head, first, length = _stretches(text[again], own[again], span)
                    known = doc[again][head]
                    new = ~again & ~same
                    at = np.flatnonzero(new)
                    lead, mask, context = _rows(start[at], place[at], hashes, span, seed)
                    at = at[lead]
                    n, none = len(at), np.zeros(len(known), np.int64)
                    h_out = anchor[at] & np.uint64((1 << anchor_bits) - 1)
                    size = context.shape[1] * 4
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([h_out, none.astype(np.uint64)]).view(np.int64), mask=np.arange(n + len(known)) >= n),
                            pa.array(np.concatenate([doc[at], known]).astype(np.int64)),
                            pa.array(np.concatenate([place[at] - w.first[text[at]], first]).astype(np.int32)),
                            pa.array(np.concatenate([np.zeros(n, np.int32), length.astype(np.int32)])),
                            pa.array(np.concatenate([mask, none]).astype(np.int32)),
                            pa.BinaryArray.from_buffers(pa.binary(), n + len(known), [None, pa.py_buffer((np.minimum(np.arange(n + len(known) + 1), n) * size).astype(np.int32)), pa.py_buffer(context.tobytes())]),
                        ],
                        ["h", "id", "place", "length", "mask", "context"],
                    )

    return texts.mapInArrow(run, "h long, id long, place int, length int, mask int, context binary")


def _extend(batches: Iterator[pa.RecordBatch], span: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Matches with the first place of the anchor, extended word by word both ways: windows inside the match are repeats; the others
    go on with a hash of their words (``w``, below their anchor and offset)."""
    width = span - seed + 1
    for batch in batches:
        if not batch.num_rows:
            continue
        h, id_, place, mask, first_id, first_place, first_mask = (batch.column(c).to_numpy() for c in ("h", "id", "place", "mask", "first_id", "first_place", "first_mask"))
        ours, theirs = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("context", "first_context"))
        later = (id_ > first_id) | ((id_ == first_id) & (place > first_place))
        itself = (id_ == first_id) & (place == first_place) & (mask == first_mask) & (ours == theirs).all(axis=1)
        equal = (ours == theirs) & (ours != 0)
        reach = lambda part: np.cumprod(part, axis=1).sum(axis=1)
        left, right = reach(equal[:, : width - 1]), reach(equal[:, width - 1 : -1])
        o = np.arange(width)
        asked = _offsets(mask, width) & ~itself[:, None]
        inside = asked & later[:, None] & equal[:, -1:] & (o <= left[:, None]) & (width - 1 - o <= right[:, None])
        hit = np.flatnonzero(inside.any(axis=1))
        most, least = width - 1 - inside[hit][:, ::-1].argmax(axis=1), inside[hit].argmax(axis=1)
        row, offset = np.nonzero(asked & ~inside)
        j = np.arange(width - 1)
        scaled = ours.astype(np.uint64) * _SCALE[: ours.shape[1]]
        w = np.where(j < offset[:, None], scaled[row, : width - 1], 0).sum(axis=1, dtype=np.uint64)
        w += np.where(j < width - 1 - offset[:, None], scaled[row, width - 1 : -1], 0).sum(axis=1, dtype=np.uint64) + scaled[row, -1]
        n, none = len(hit), np.zeros(len(hit), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([id_[hit], id_[row]])),
                pa.array(np.concatenate([place[hit] - most, place[row] - offset]).astype(np.int32)),
                pa.array(np.concatenate([most - least + span, np.zeros(len(row), np.int64)]).astype(np.int32)),
                pa.array(np.concatenate([none, h[row]])),
                pa.array(np.concatenate([none, offset]).astype(np.int32)),
                pa.array(np.concatenate([none.astype(np.uint64), mix(w)]).view(np.int64)),
            ],
            ["id", "first", "length", "h", "offset", "w"],
        )


def repeats(texts: DataFrame, span: int = 20, seed: int = 8, anchor_bits: int = 64) -> DataFrame:
    """``(id, first, length)``: stretches of words of windows that occur earlier. ``texts``: ``id`` long, ``text``.

    Earlier: in a document of a smaller id, or at a smaller place of the same one. ``anchor_bits`` cuts the anchors' hashes
    short, for tests of what happens when they collide.
    """
    common = bit_set(anchor_counts(texts, span, seed).where("n > 1").select("h"))
    shared = texts.sparkSession.sparkContext.broadcast(common)
    found = _occurrences(texts, shared, span, seed, anchor_bits)
    seeds = found.where("h IS NOT NULL").drop("length")
    # The least place of every anchor, by partial minima; all its other places are joined with that one, so a common anchor's are split.
    first = F.min(F.struct("id", "place", "context", "mask")).alias("first")
    firsts = seeds.groupBy("h").agg(first, F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("h", F.col("first.id").alias("first_id"), F.col("first.place").alias("first_place"), F.col("first.context").alias("first_context"), F.col("first.mask").alias("first_mask"))
    kinds = "id long, first int, length int, h long, offset int, w long"
    extended = durable(seeds.join(firsts, "h").mapInArrow(lambda batches: _extend(batches, span, seed), kinds), "extended")
    # Windows that differ from those at their anchor's first place are repeats of one another if all their words agree.
    rest = extended.where("length = 0").select("h", "offset", "w", "id", "first")
    key = ["h", "offset", "w"]
    least = rest.groupBy(*key).agg(F.min(F.struct("id", "first")).alias("least"), F.count("*").alias("n")).where("n > 1")
    others = rest.join(least, key).where(F.struct("id", "first") > F.col("least")).select("id", "first", F.lit(span).alias("length"))
    within = found.where("h IS NULL").select("id", F.col("place").alias("first"), "length")
    return extended.where("length > 0").select("id", "first", "length").union(others).union(within)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 20, seed: int = 8) -> DataFrame:
    """``(id, n_words, n_removed, kept)`` for every row: words of repeated windows go, the rest is joined by spaces.

    The first occurrence of a window stays; windows are judged on the input. Null texts have no words; texts
    shorter than a window keep all. A null id counts as the largest. Rows of one id are one document:
    equal rows get the same result. Whole texts are read; an empty table gives an empty result.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = repeats(texts, span, seed).groupBy("id").agg(F.collect_list("first").alias("firsts"), F.collect_list("length").alias("lengths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, lengths = batch.column(2), batch.column(3)
            n_words, n_removed, kept = [], [], []
            for w in slices(batch.column(1)):
                for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
                    row, n = w.row + i, int(b - a)
                    starts, ends, keep = w.starts[a:b], w.ends[a:b], None
                    if firsts[row].is_valid:
                        step = np.zeros(n + 1, np.int32)
                        f, k = firsts[row].values.to_numpy(), lengths[row].values.to_numpy()
                        inside = f < n
                        np.add.at(step, f[inside], 1)
                        np.add.at(step, np.minimum(f + k, n)[inside], -1)
                        keep = np.cumsum(step[:-1]) == 0
                        starts, ends = starts[keep], ends[keep]
                    base = w.text_starts[i]
                    line = w.data[base : w.text_starts[i + 1]].tobytes()
                    n_words.append(n)
                    n_removed.append(n - len(starts))
                    kept.append(b" ".join(line.split() if keep is None else [line[s:e] for s, e in zip((starts - base).tolist(), (ends - base).tolist())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "kept"],
            )

    out = texts.join(found, "id", "left").select("id", "text", "firsts", "lengths")
    out = out.mapInArrow(run, "id long, n_words long, n_removed long, kept string")
    return out.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id")))
