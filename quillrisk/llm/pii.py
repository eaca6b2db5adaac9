"""Personal data: base spans by pattern, and terms that give protected entities away.

Every value of a base span (an address, a number) is a protected entity. Over the whole corpus, terms near
its spans are counted with it; a term ``t`` discloses an entity ``e`` by
``log2 P(e | t) / P(e)`` bits. Terms that tell more than the threshold, and name their entity often
enough, are generalised (a placeholder) or, when they nearly always point to it, removed wherever they occur.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrisk.llm._bits import bit_set, in_bits
from quillrisk.llm._tokens import slices
from quillrisk.session import durable

KINDS = ("email", "ip", "card", "phone")
#: Disclosing terms up to this many are sent to every task (8 MB); beyond it they are joined.
MAX_SENT_TERMS = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]{7,}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match has one ``@``, so it is looked for around every one of them, in time that follows the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four runs of digits with single dots between them, from the left; a run ends where its digits end."""
    for stretch in _DOTTED.finditer(text):
        if stretch[0].count(".") < 3:
            continue
        at, runs = stretch.start(), []
        for part in stretch[0].split("."):
            runs = [*runs, (at, part)] if part else []
            at += len(part) + 1
            if len(runs) == 4:
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for _, p in runs):
                    yield runs[0][0], at - 1
                runs = []


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind as in ``KINDS``, then start; code points, ends exclusive."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, a, b) for a, b in _addresses(text)]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0]) if len(m[0]) >= 16 else ""
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return out


def _entity(kind: int, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def _places(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Byte offsets to code points."""
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(lead)])[at]


def _near(docs: DataFrame, window: int) -> DataFrame:
    """``(entity, term)``, once a document: a term's hash near a span. Null terms stand for the entity
    itself, null entities for any: the documents in which a term is near some span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: list[tuple[int | None, int | None]] = []
            texts = batch.column(1)
            for w in slices(texts, True):
                hashes = None
                for i in range(len(w.first) - 1):
                    text = texts[w.row + i].as_py() or ""
                    if not (spans := base_spans(text)):
                        continue
                    hashes = w.hashes() if hashes is None else hashes
                    a, b = w.first[i], w.first[i + 1]
                    raw = w.data[w.text_starts[i] : w.text_starts[i + 1]].tobytes()
                    starts, ends = (_places(raw, x[a:b] - w.text_starts[i]) for x in (w.starts, w.ends))
                    taken = np.zeros(b - a, bool)
                    for _, s, e in spans:
                        taken |= (starts < e) & (ends > s)
                    mine: set[tuple[int, int | None]] = set()
                    for kind, s, e in spans:
                        entity = _entity(kind, text[s:e])
                        lo, hi = np.searchsorted(ends, s, side="right"), np.searchsorted(starts, e)
                        lo, hi = max(0, lo - window), min(b - a, hi + window)
                        mine.add((entity, None))
                        mine |= {(entity, int(h)) for h in hashes[a + lo : a + hi][~taken[lo:hi]].view(np.int64)}
                    pairs += mine
                    pairs += {(None, t) for _, t in mine if t is not None}
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["entity", "term"])

    return docs.mapInArrow(run, "entity long, term long")


def _term_documents(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, docs)``: documents that hold each of ``terms (term)``."""
    known = docs.sparkSession.sparkContext.broadcast(bit_set(terms.select(F.col("term").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(1), True):
                h = w.hashes()
                hit = in_bits(h, known.value)
                pairs = np.unique(np.stack([h[hit], w.text_of[hit].astype(np.uint64)]), axis=1) if hit.any() else np.zeros((2, 0), np.uint64)
                term, n = np.unique(pairs[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["term", "n"])

    found = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("docs"))
    return terms.join(found, "term").select("term", "docs")


def disclosing_terms(
    docs: DataFrame, window: int = 8, min_together: int = 3, min_share: float = 0.5, min_bits: float = 4.0
) -> DataFrame:
    """``(term, share, bits)``: terms that give an entity away, with their strongest entity's figures.

    ``share`` is P(entity | term) over documents, ``bits`` the term's information about the entity. Terms
    that stand with an entity in fewer than ``min_together`` documents tell nothing reliable.
    """
    counts = _near(docs, window).groupBy("entity", "term").agg(F.count("*").alias("n"))
    counts = durable(counts.where(F.col("term").isNull() | (F.col("n") >= min_together)), "disclosure")
    entities = counts.where("term IS NULL").select("entity", F.col("n").alias("entity_docs"))
    pairs = counts.where("term IS NOT NULL AND entity IS NOT NULL").select("entity", "term", F.col("n").alias("together"))
    # A term is in no fewer documents than it is near some span in, so the others cannot reach the share.
    near = counts.where("entity IS NULL").select("term", F.col("n").alias("near_docs"))
    pairs = pairs.join(near, "term").where(F.col("together") >= F.col("near_docs") * min_share).drop("near_docs")
    total = docs.count()
    frequency = durable(_term_documents(docs, pairs.select("term").distinct()), "term-documents")
    share = F.col("together") / F.col("docs")
    scored = pairs.join(frequency, "term").join(entities, "entity").withColumn("share", share)
    scored = scored.withColumn("bits", F.log2(F.col("share") * F.lit(float(total)) / F.col("entity_docs")))
    scored = scored.where((F.col("share") >= min_share) & (F.col("bits") >= min_bits))
    return scored.groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits"))


def _spans_of(known: np.ndarray | None, bits: np.ndarray | None, w, hashes: np.ndarray) -> np.ndarray:
    """Indexes of the words of a slice that are in the sorted ``known`` or may be in ``bits``."""
    if bits is not None:
        return np.flatnonzero(in_bits(hashes, bits))
    if not len(known):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.flatnonzero(known[at] == hashes)


def sanitise(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 8,
    min_together: int = 3,
    min_share: float = 0.5,
    min_bits: float = 4.0,
    remove_share: float = 0.9,
    max_sent_terms: int = MAX_SENT_TERMS,
) -> DataFrame:
    """``(id, spans, clean)`` for every row; ``spans`` is an array of ``kind:start:end``.

    Base spans come first (email, ip, card, phone, each by start), then spans of disclosing terms
    (``term``), which never overlap base ones. ``clean`` is the text with base spans and generalised terms replaced
    by ``[KIND]`` and removed terms (share of ``remove_share`` or more) left out. A null text counts as
    empty; ids are passed through, nulls too; repeated rows get equal results and count as documents of their own.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    terms = durable(disclosing_terms(texts, window, min_together, min_share, min_bits), "disclosing")
    kind = texts.schema["id"].dataType.simpleString()
    if terms.count() <= max_sent_terms:
        rows = terms.select("term", (F.col("share") >= remove_share).alias("gone")).toPandas()  # at most max_sent_terms
        key = rows["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(key)
        sent = docs.sparkSession.sparkContext.broadcast((key[order], rows["gone"].to_numpy(bool)[order]))
        source = texts.withColumn("found", F.lit(None).cast("array<struct<word:int,gone:boolean>>"))
    else:
        sent = None
        source = _join_terms(texts, terms, remove_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, spans_out, clean = batch.column(1), batch.column(2), [], []
            for w in slices(texts, True):
                hits: dict[int, list[tuple[int, bool]]] = {}
                if sent is not None and len(sent.value[0]):
                    hashes = w.hashes()
                    for j in _spans_of(sent.value[0], None, w, hashes).tolist():
                        t = int(np.searchsorted(w.first, j, side="right")) - 1
                        hits.setdefault(t, []).append((j, bool(sent.value[1][np.searchsorted(sent.value[0], hashes[j])])))
                for i in range(len(w.first) - 1):
                    text = texts[w.row + i].as_py() or ""
                    if sent is None and found[w.row + i].is_valid:
                        hits[i] = [(int(w.first[i]) + x["word"], x["gone"]) for x in found[w.row + i].as_py()]
                    spans = base_spans(text)
                    if not spans and i not in hits:
                        spans_out.append([])
                        clean.append(text)
                        continue
                    marks = [(s, e, KINDS[k], False) for k, s, e in spans]
                    if i in hits:
                        raw = w.data[w.text_starts[i] : w.text_starts[i + 1]].tobytes()
                        index = np.array([j for j, _ in hits[i]])
                        starts, ends = (_places(raw, x[index] - w.text_starts[i]).tolist() for x in (w.starts, w.ends))
                        free = np.ones(len(index), bool)
                        for _, s, e in spans:
                            free &= ~((np.array(starts) < e) & (np.array(ends) > s))
                        marks += [(s, e, "term", gone) for s, e, (_, gone), f in zip(starts, ends, hits[i], free) if f]
                    spans_out.append([f"{k}:{s}:{e}" for s, e, k, _ in marks])
                    parts, at = [], 0
                    for s, e, k, gone in sorted(marks):
                        parts += [text[at : max(at, s)], "" if gone else f"[{k.upper()}]"] if e > at else []
                        at = max(at, e)
                    clean.append("".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans_out, pa.list_(pa.string())), pa.array(clean, pa.string())], ["id", "spans", "clean"]
            )

    return source.select("id", "text", "found").mapInArrow(run, f"id {kind}, spans array<string>, clean string")


def _join_terms(texts: DataFrame, terms: DataFrame, remove_share: float) -> DataFrame:
    """``texts`` with ``found``: places of disclosing words, by a join of the words that may be among ``terms``."""
    bits = texts.sparkSession.sparkContext.broadcast(bit_set(terms.select(F.col("term").alias("h"))))
    keyed = texts.withColumn("row", F.xxhash64(F.col("id").cast("string"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(1), True):
                h = w.hashes()
                index = _spans_of(None, bits.value, w, h)
                text = np.searchsorted(w.first, index, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(w.row + text)), pa.array(h[index].view(np.int64)), pa.array((index - w.first[text]).astype(np.int32))],
                    ["row", "term", "word"],
                )

    words = keyed.select("row", "text").dropDuplicates(["row"]).mapInArrow(run, "row long, term long, word int")
    found = words.join(terms.select("term", (F.col("share") >= remove_share).alias("gone")), "term")
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("word", "gone"))).alias("found"))
    return keyed.join(found, "row", "left").select("id", "text", "found")
