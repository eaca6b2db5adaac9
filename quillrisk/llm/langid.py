"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of character n-grams (byte trigrams of letters, hashed). Each
language has several centroids, clustered from a bounded sample; a text gets the language of the centroid
with the highest cosine, and is rejected if even that is farther away than the centroid's own members are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrisk.llm._tasks import in_one_task
from quillrisk.llm._tokens import slices
from quillrisk.session import durable

DIMS = 4096
UNKNOWN = "und"
#: Digits, white space and ASCII punctuation all count as one kind of break.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``part``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == part


def sample_per_group(rows: DataFrame, group: str, key: str, most: int, turns: int = 64) -> DataFrame:
    """At most ``most`` rows of each group, those of the least hashes; large groups are cut in turns first."""
    hashed = rows.withColumn("_hash", F.xxhash64(key)).withColumn("_turn", F.pmod(F.col("_hash"), F.lit(turns)))
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("_hash", key))
    first = hashed.withColumn("_rank", best(group, "_turn")).where(F.col("_rank") <= most)
    return first.withColumn("_rank", best(group)).where(F.col("_rank") <= most).drop("_hash", "_turn", "_rank")


def _counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First row and trigram counts of a few texts at a time."""
    for w in slices(texts):
        n, data = len(w.first) - 1, _FOLD[w.data].astype(np.uint32)
        if len(data) < 3:
            yield w.row, np.zeros((n, DIMS), np.float32)
            continue
        gram = (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))
        gram = (gram * np.uint32(0x27D4EB2F)) >> np.uint32(20)
        text = np.repeat(np.arange(n), np.diff(w.text_starts))
        # Runs of breaks tell nothing of a language; trigrams do not cross texts.
        good = (text[:-2] == text[2:]) & ((data[1:-1] != 32) | ((data[:-2] != 32) & (data[2:] != 32)))
        at = text[:-2][good] * DIMS + gram[good]
        yield w.row, np.bincount(at, minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Centroids:
    idf: np.ndarray
    vectors: np.ndarray
    langs: list[str]
    reach: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest centroid, its cosine, and whether it is too far away."""
        near = _unit(np.sqrt(counts) * self.idf) @ self.vectors.T
        best = near.argmax(axis=1)
        top = near[np.arange(len(best)), best]
        return best, np.clip(top, 0, 1), top < self.reach[best]


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from the farthest points: centroids that have members, and each row's."""
    centres = [_unit(x.mean(axis=0, keepdims=True))[0]]
    while len(centres) < min(k, len(x)):
        centres.append(x[(x @ np.array(centres).T).max(axis=1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        mine = (x @ c.T).argmax(axis=1)
        c = np.array([x[mine == i].mean(axis=0) if (mine == i).any() else c[i] for i in range(len(c))])
        c = _unit(c)
    used, mine = np.unique((x @ c.T).argmax(axis=1), return_inverse=True)
    return c[used], mine


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, centroids: int = 4, docs_per_lang: int = 400, most_sent: int = 1 << 17) -> Centroids:
    """Centroids from at most ``docs_per_lang`` texts of each language (those of the least hashes of their ids).

    The ids that were chosen go to every task while they are ``most_sent`` at most, so that the texts stay where they are; texts become counts
    of n-grams there, and one task clusters those. Rows with a null text or language are left out.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    chosen = durable(sample_per_group(rows.select("id", "lang"), "lang", "id", docs_per_lang), "lang-sample")
    if chosen.count() <= most_sent:
        chosen = F.broadcast(chosen)
    picked = rows.join(chosen, ["id", "lang"], "left_semi").select("lang", F.md5("text").alias("mark"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, counts in _counts(batch.column(2)):
                own = batch.slice(row, len(counts))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(list(counts), pa.list_(pa.float32()))], ["lang", "mark", "counts"])

    return in_one_task(picked.mapInArrow(count, "lang string, mark string, counts array<float>"), lambda got: _fit(got, centroids))


def _fit(got: pa.Table | None, centroids: int) -> Centroids:
    """Centroids of ``(lang, mark, counts)``, the same whatever the order of the rows."""
    if got is None:
        return Centroids(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], np.zeros(0, np.float32))
    lang, mark = (got[c].to_numpy() for c in ("lang", "mark"))
    order = np.lexsort((mark, lang))
    lang, counts = lang[order], got["counts"].combine_chunks().values.to_numpy().reshape(-1, DIMS)[order]
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = _unit(np.sqrt(counts) * idf)
    vectors, langs, reach = [], [], []
    for name in sorted(set(lang)):
        own = x[lang == name]
        c, mine = cluster(own, centroids)
        near = (own * c[mine]).sum(axis=1)
        for i in range(len(c)):
            reach.append(0.5 * float(near[mine == i].min()))
        vectors.append(c.astype(np.float32))
        langs += [name] * len(c)
    return Centroids(idf, np.concatenate(vectors), langs, np.array(reach, np.float32))


def identify(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang, nearest, score, rejected)`` for every row.

    ``nearest`` is the language of the nearest centroid and ``score`` the cosine; ``lang`` is the same
    unless the text is rejected, then ``und``. Null texts and texts without a letter are ``und`` in both with score 0, as is
    all if no language was learned. Whole texts are read; repeated rows get equal results.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.lower(F.col(text_col).cast("string")).alias("text"),
        F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            n, letters = batch.num_rows, batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, score, far = np.full(n, len(model.langs)), np.zeros(n), np.ones(n, bool)
            if model.langs:
                for row, counts in _counts(batch.column(1)):
                    part = slice(row, row + len(counts))
                    best[part], score[part], far[part] = model.predict(counts)
            best[~letters], score[~letters], far[~letters] = len(model.langs), 0.0, True
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.where(far, UNKNOWN, names[best])), pa.array(names[best]), pa.array(score.astype(np.float64)), pa.array(far)],
                ["id", "lang", "nearest", "score", "rejected"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang string, nearest string, score double, rejected boolean")
