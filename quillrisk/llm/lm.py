"""Language-model scoring: a causal self-attention model over subword ids joined with word counts, and a unigram base line.

The base counts words over all training texts by a distributed count; the commonest words' counts go to every task,
the others are joined. In the model a text is a sequence of words from one of several topics (or from all of them together). A word is
either one that the topic's counts and the text so far know, or it is spelled: attention over the subwords before it
gives the probability of every subword, and their product is the share of the spelled mass that the word gets::

    P(word | topic, before) = (max(c - D, 0) + R * m + M * P_attention(subwords | window)) / (C + V + R * j)

with c the word's count in the topic, m its count among the j words before it in the text, C and V all tokens and distinct words of
the topic, and M what is left of C + V. That sums to one over all words. The attention learns from all words of
all training texts; a word weighs one over its count there, as spelling is for words that counts do not know.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrisk.llm._attention import DIM, WINDOW, Attention, Layout, Steps, windows
from quillrisk.llm._packed import pack, unpack
from quillrisk.llm._tasks import in_one_task
from quillrisk.llm._tokens import Words, slices
from quillrisk.session import durable

#: A public byte-level BPE vocabulary in tiktoken's format.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose counts go to every task (12 MB).
SENT_WORDS = 1 << 18
#: Texts that the first centres of topics come from. Everything else covers all training texts.
START_TEXTS = 1200
TOPICS, BUCKETS = 10, 4096
#: Rounds of k-means over all texts at most, and texts that are bags together.
ROUNDS, BAG_TEXTS = 20, 256
#: The first pass of the attention over the corpus: shares of the texts, steps of how many windows, and their rate. The model is put together after each part. Corpora of
#: fewer windows than ``LEAST_WINDOWS`` are passed over again, ``PASSES`` times at most.
PARTS = ((1 / 16, 128, 0.02), (3 / 16, 128, 0.02), (1 / 4, 256, 0.015), (1 / 2, 256, 0.01))
LEAST_WINDOWS, PASSES = 460_800, 12
DISCOUNT, RECENT = 0.6, 2.0
#: The pass over the corpus takes steps on this share of all blocks of so many words: on whole texts. Less draws blocks at random in every text.
STEP_SHARE, BLOCK_WORDS = 1.0, 32
_CACHE_WORDS = 120_000
_TEXTS = 1000  # kinds of count rows from here on count texts
_state: dict = {}


def vocabulary(path: str = VOCABULARY, spark: SparkSession | None = None) -> bytes:
    """A vocabulary file; one with a scheme (``hdfs://...``) is read by Spark."""
    if "://" in path and spark is not None:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


@dataclass
class Tokens:
    """Texts end to end as subwords and as words; every text has an end, which is a word too (unit ``len(hashes)``)."""

    ids: np.ndarray
    begin: np.ndarray  # of every word in ids
    first: np.ndarray  # of every text in ids
    hashes: np.ndarray  # distinct words
    unit: np.ndarray  # of every word in hashes
    text_first: np.ndarray  # of every text in words


class Subwords:
    """Subword ids of words; a word is encoded with a space before it, a text ends with ``end``."""

    def __init__(self, raw: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.known: dict[int, bytes] = {}  # ids of 32 bits

    @classmethod
    def of(cls, raw: bytes) -> Subwords:
        """One for each worker."""
        if _state.get("raw") != raw:
            _state.update(raw=raw, subwords=cls(raw))
        return _state["subwords"]

    def of_words(self, w: Words, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (hashes, and where each first occurs) end to end, and where each word's begin."""
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        line, known, encode, out = w.data.tobytes(), self.known, self.encoding._encode_single_piece, []
        for h, a, b in zip(hashes.tolist(), w.starts[at].tolist(), w.ends[at].tolist()):
            ids = known.get(h)
            if ids is None:
                ids = known[h] = array("I", encode(b" " + line[a:b])).tobytes()
            out.append(ids)
        size = np.fromiter(map(len, out), np.int64, len(out)) // 4
        return np.frombuffer(b"".join(out), np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(size)])

    def tokens(self, w: Words) -> Tokens:
        hashes, at, index = np.unique(w.hashes(), return_index=True, return_inverse=True)
        ids, first = self.of_words(w, hashes, at)
        ids, first = np.append(ids, self.end), np.append(first, len(ids) + 1)
        unit = np.insert(index, w.first[1:], len(hashes))
        size = np.take(np.diff(first), unit)
        begin = np.cumsum(size) - size
        flat = np.take(ids, np.arange(size.sum()) + np.repeat(np.take(first, unit) - begin, size))
        text_first = w.first + np.arange(len(w.first))
        return Tokens(flat, begin, np.append(begin[text_first[:-1]], len(flat)), hashes, unit, text_first)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(52)).astype(np.int64)


def _bags(texts: DataFrame) -> DataFrame:
    """Bags of words of ``texts (text)``, some texts a row, packed: buckets and how often each occurs, end to end, and how many buckets a text has. Texts without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BAG_TEXTS):
                for w in slices(batch.column(0).slice(at, BAG_TEXTS), True):
                    bag = np.bincount(w.text_of * BUCKETS + _buckets(w.hashes()), minlength=len(w.counts) * BUCKETS)
                    some = np.flatnonzero(bag)
                    size = np.bincount(some // BUCKETS, minlength=len(w.counts))
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array([pack(c)], pa.binary()) for c in (some % BUCKETS, bag[some], size[size > 0])], ["bucket", "n", "size"])

    return texts.select("text").mapInArrow(run, "bucket binary, n binary, size binary")


def _each_bag(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(unpack(batch.column(k)[i].as_py()) for k in range(3))


def _unit(bucket: np.ndarray, n: np.ndarray, size: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Bags as rows of length 1: square roots of counts, weighted by how few texts have the bucket."""
    value = (np.sqrt(n) * idf[bucket]).astype(np.float32)
    length = np.sqrt(np.add.reduceat(value * value, np.cumsum(size, dtype=np.int64) - size))
    out = np.zeros((len(size), BUCKETS), np.float32)
    out[np.repeat(np.arange(len(size)), size), bucket] = value / np.repeat(np.maximum(length, 1e-9), size)
    return out


def _sums(bags: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all bags of ``of``'s ``(rows)`` and ``(rows, BUCKETS)``, added up in the tasks and by row; as much reaches the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, many = np.zeros(rows), np.zeros((rows, BUCKETS))
        for bag in _each_bag(batches):
            for total, part in zip((one, many), of(*bag)):
                total += part
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows), pa.int32()), pa.array(one), pa.array(list(many), pa.list_(pa.float64()))], ["row", "one", "many"])

    def add(parts: pa.Table) -> pa.Table:
        many = parts["many"].combine_chunks().flatten().to_numpy().reshape(-1, BUCKETS).sum(axis=0)
        return pa.table({"row": parts["row"][:1], "one": [float(np.sum(parts["one"].to_numpy()))], "many": pa.array([many], pa.list_(pa.float64()))})

    schema = "row int, one double, many array<double>"
    got = bags.mapInArrow(run, schema).groupBy("row").applyInArrow(add, schema).toArrow()
    one, many = np.zeros(rows), np.zeros((rows, BUCKETS))
    for i, row in enumerate(got["row"].to_pylist()):
        one[row], many[row] = got["one"][i].as_py(), got["many"][i].values.to_numpy()
    return one, many


def _topics(bags: np.ndarray, topics: int, tries: int = 5, rounds: int = 20) -> np.ndarray:
    """A topic for every bag of words: the best of some spherical k-means runs from random bags, longer ones likelier."""
    x = np.sqrt(bags) * np.log((2 + len(bags)) / (1 + (bags > 0).sum(axis=0)))
    x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    best, out = -1.0, np.zeros(len(x), np.int64)
    for seed in range(tries):
        c = x[np.random.default_rng(seed).choice(len(x), min(topics, len(x)), replace=False, p=bags.sum(axis=1) / bags.sum())]
        for _ in range(rounds):
            near = x @ c.T
            mine = near.argmax(axis=1)
            if near.max(axis=1).sum() > best:
                best, out = near.max(axis=1).sum(), mine
            c = np.stack([x[mine == k].sum(axis=0) if (mine == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return np.unique(out, return_inverse=True)[1]


def _first_centres(texts: DataFrame, most: int, idf: np.ndarray, topics: int) -> np.ndarray:
    """``(topics, BUCKETS)``: centres of clusters of at most ``most`` texts, those of the least hashes; only about twice as many are ever sorted."""
    mark = F.xxhash64("text")
    few = texts.where(mark < int(-(2.0**63) + min(1.0, 2.0 * most / max(texts.count(), 1)) * (2.0**64 - 4096)))

    def work(rows: pa.Table | None) -> np.ndarray:
        parts = list(_each_bag(iter(rows.to_batches() if rows is not None else [])))
        if not parts:
            return np.zeros((0, BUCKETS), np.float32)
        bucket, n, size = map(np.concatenate, zip(*parts))
        bags = np.zeros((len(size), BUCKETS))
        bags[np.repeat(np.arange(len(size)), size), bucket] = n
        order = np.lexsort(bags.T)
        mine = _topics(bags[order], topics)
        x = _unit(bucket, n, size, idf)[order]
        sums = np.stack([x[mine == k].sum(axis=0) for k in range(mine.max() + 1)])
        return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)

    return in_one_task(_bags(few.select("text").orderBy(mark, "text").limit(most)), work)


def topic_counts(texts: DataFrame, topics: int = TOPICS, start_texts: int = START_TEXTS) -> np.ndarray:
    """``(topics, BUCKETS)``: how often words of a bucket occur in the texts of a topic, from clusters of all ``texts (text)`` by their words.

    Spherical k-means: a round is one pass over the bags of all texts, and rounds end when the fit grows no more. Only the centres that it begins with come from
    at most ``start_texts`` texts.
    """
    spark = texts.sparkSession
    bags = durable(_bags(texts), "lm-bags")
    n, seen = _sums(bags, lambda bucket, n, size: (np.array([len(size)]), np.bincount(bucket.astype(np.int64), minlength=BUCKETS)[None]), 1)
    idf = np.log((2 + n[0]) / (1 + seen[0]))
    centres = _first_centres(texts, start_texts, idf, topics)
    if not len(centres):
        return np.zeros((0, BUCKETS))
    k, last, kept = len(centres), 0.0, centres
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(centres)

        def move(bucket: np.ndarray, n: np.ndarray, size: np.ndarray, sent=sent) -> tuple[np.ndarray, np.ndarray]:
            x = _unit(bucket, n, size, idf)
            near = x @ sent.value.T
            mine = (np.arange(k) == near.argmax(axis=1)[:, None]).astype(np.float32)
            return (mine * near).sum(axis=0, dtype=np.float64), mine.T @ x

        fit, sums = _sums(bags, move, k)
        sent.unpersist()
        if fit.sum() <= last * (1 + 1e-5):
            break
        last, kept = fit.sum(), centres
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-9), centres).astype(np.float32)
    sent = spark.sparkContext.broadcast(kept)

    def count(bucket: np.ndarray, n: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = (_unit(bucket, n, size, idf) @ sent.value.T).argmax(axis=1)
        at = np.repeat(mine, size) * BUCKETS + bucket.astype(np.int64)
        return np.bincount(mine, minlength=k), np.bincount(at, n, k * BUCKETS).reshape(k, BUCKETS)

    texts_of, out = _sums(bags, count, k)
    return out[texts_of > 0]


def topics_of(texts: DataFrame, topics: int = TOPICS, start_texts: int = START_TEXTS) -> np.ndarray:
    """``(topics, BUCKETS)``: ln P(bucket of a word | topic)."""
    sums = topic_counts(texts, topics, start_texts) + 1.0
    sums = sums if len(sums) else np.ones((1, BUCKETS))
    return np.log(sums / sums.sum(axis=1, keepdims=True)).astype(np.float32)


def counts_of(texts: DataFrame, topics: np.ndarray) -> DataFrame:
    """``(kind, key, n)`` over all ``texts (id, text)``: words by topic (kind: the topic of their text; key: hash), and texts by topic
    (kind 1000 and up)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_topics = len(topics)
        ends = np.zeros(n_topics, np.int64)
        row = lambda kind, key, n: pa.RecordBatch.from_arrays(
            [pa.array(kind.astype(np.int32)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"]
        )
        for batch in batches:
            for w in slices(batch.column(1), True, max_bytes=1 << 21):
                hashes = w.hashes()
                fit = topics.T[_buckets(hashes)]
                fit = np.add.reduceat(np.concatenate([fit, np.zeros((1, n_topics), np.float32)]), w.first[:-1], axis=0) * (w.counts > 0)[:, None]
                mine = fit.argmax(axis=1)
                ends += np.bincount(mine, minlength=n_topics)
                order = np.argsort(mine[w.text_of].astype(np.uint8), kind="stable")
                edges = np.searchsorted(mine[w.text_of][order], np.arange(n_topics + 1))
                for k in np.flatnonzero(np.diff(edges)):
                    h, n = np.unique(hashes[order[edges[k] : edges[k + 1]]], return_counts=True)
                    yield row(np.full(len(h), k), h.view(np.int64), n)
        yield row(_TEXTS + np.arange(n_topics), np.zeros(n_topics), ends)

    return texts.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _commonest(words: DataFrame, most: int, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts (``columns``) of the commonest words: as many classes of like counts as fit ``most`` words."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)  # 8 a doubling
    levels = words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).toArrow().sort_by([("level", "descending")])
    fit = levels["level"].to_numpy()[np.cumsum(levels["words"].to_numpy()) <= most]
    if not len(fit):
        return np.zeros(0, np.uint64), np.zeros((0, len(columns)), np.float32)
    rows = words.where(level >= int(fit.min())).select("key", *[F.col(c).cast("double") for c in columns]).toArrow()
    key = rows["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], np.stack([rows[c].to_numpy()[order] for c in columns], axis=1)


@dataclass
class Counts:
    """What every task knows of words: sorted keys and counts ``n`` of the commonest, then of the end of a text and of all other words (0).

    ``known`` has a row for each of these, with a column a topic and one for all: their counts less the discount. By column: ``all_tokens``,
    ``all_words``, and ``mass``, what is left for words to be spelled.
    """

    key: np.ndarray
    n: np.ndarray
    known: np.ndarray
    all_tokens: np.ndarray
    all_words: np.ndarray
    mass: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, table: np.ndarray, all_tokens: np.ndarray, all_words: np.ndarray) -> Counts:
        """From counts by column (the row of the end last), all tokens and all distinct words."""
        mass = all_words + DISCOUNT * (table > 0).sum(axis=0) + all_tokens - table.sum(axis=0)
        known = np.concatenate([np.maximum(table - DISCOUNT, 0), np.zeros((1, table.shape[1]))]).astype(np.float32)
        return cls(key, np.append(table[:, -1], 0).astype(np.int64), known, all_tokens, all_words, mass)

    def rows_of(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of distinct words and, last, of the end."""
        n = len(self.key)
        at = np.minimum(np.searchsorted(self.key, hashes), max(0, n - 1))
        return np.append(np.where(self.key[at] == hashes, at, n + 1) if n else np.full(len(hashes), 1), n)


def _earlier(t: Tokens) -> np.ndarray:
    """How often every word was in its text before."""
    size = np.diff(t.text_first)
    text = np.repeat(np.arange(len(size)), size)
    key = text * (len(t.hashes) + 1) + t.unit
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    seen = np.empty(len(key), np.int64)
    seen[order] = np.arange(len(key)) - np.repeat(head, np.diff(np.append(head, len(key))))
    return seen


def mixture(t: Tokens, spelled: np.ndarray, counts: Counts, rows: np.ndarray) -> np.ndarray:
    """Log10 probability of every text. ``spelled``: ln of the attention's probability of every word."""
    tokens, words = counts.all_tokens, np.maximum(counts.all_words, 1)
    mass = np.where(tokens > 0, counts.mass, 1)
    prior = tokens if tokens[-1] else np.where(np.arange(len(tokens)) == len(tokens) - 1, 1, 0)  # an empty topic has no share
    seen, size = _earlier(t), np.diff(t.text_first)
    value = np.take(np.take(counts.known, rows, axis=0), t.unit, axis=0)  # distinct words first
    value += (RECENT * seen).astype(np.float32)[:, None]
    tiny = np.flatnonzero(spelled < -60)  # too small for 32 bits beside a mass
    with np.errstate(divide="ignore"):
        fixed = np.logaddexp(np.log(value[tiny].astype(np.float64)), spelled[tiny][:, None] + np.log(mass))
    value += np.exp(spelled).astype(np.float32)[:, None] * mass.astype(np.float32)
    with np.errstate(divide="ignore"):
        np.log(value, out=value)
    value[tiny] = 0
    sums = np.add.reduceat(value, t.text_first[:-1], axis=0, dtype=np.float64)
    np.add.at(sums, np.searchsorted(t.text_first, tiny, side="right") - 1, fixed)
    # What is divided by depends on the place in the text alone.
    before = np.log((tokens + words) + RECENT * np.arange(size.max())[:, None]).cumsum(axis=0)
    with np.errstate(divide="ignore"):
        sums += np.log(prior / prior.sum()) - before[size - 1]
    top = sums.max(axis=1)
    return (top + np.log(np.exp(sums - top[:, None]).sum(axis=1))) / np.log(10)


@dataclass
class Speller:
    """The attention with its subword rows."""

    layout: Layout
    net: Attention
    size: int = 0  # subwords of the training texts

    def spell(self, t: Tokens) -> np.ndarray:
        """ln of the probability of every word, from the window of subwords before each of its subwords."""
        value = self.net.text_log_p(np.take(self.layout.row, t.ids), t.first)
        value += np.take(self.layout.rest, t.ids)
        return np.add.reduceat(value, t.begin)


def weights(t: Tokens, counts: Counts, rows: np.ndarray) -> np.ndarray:
    """Of every word: one over its count."""
    return (1 / np.maximum(counts.n[rows], 1)).astype(np.float32)[t.unit]


def _spread(t: Tokens, weight: np.ndarray) -> np.ndarray:
    """Weights of words as weights of their subwords."""
    return np.repeat(weight, np.diff(np.append(t.begin, len(t.ids))))


def start(texts: DataFrame, raw, sent, seed: int = 1) -> Speller:
    """The model before any step. Its rows of subwords, their classes and the shares that outputs begin with come from the subwords of all ``texts (.., text)``."""
    n_ids = Subwords.of(raw.value).end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, counts, pieces, weight = Subwords.of(raw.value), sent.value, np.zeros(n_ids, np.int64), np.zeros(n_ids)
        for batch in batches:
            for w in slices(batch.column(0), True, max_bytes=1 << 21):
                hashes, at, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                ids, first = subwords.of_words(w, hashes, at)
                ids, size, n = np.append(ids, subwords.end), np.append(np.diff(first), 1), np.append(n, len(w.counts))
                pieces += np.bincount(ids, np.repeat(n, size), n_ids).astype(np.int64)
                weight += np.bincount(ids, np.repeat(n / np.maximum(counts.n[counts.rows_of(hashes)], 1), size), n_ids)
        some = np.flatnonzero(pieces)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(pieces[some]), pa.array(weight[some])], ["id", "n", "weight"])

    found = texts.select("text").mapInArrow(run, "id long, n long, weight double").groupBy("id").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).toArrow()
    pieces, weight = np.zeros(n_ids), np.zeros(n_ids)
    pieces[found["id"].to_numpy()], weight[found["id"].to_numpy()] = found["n"].to_numpy(), found["weight"].to_numpy()
    layout = Layout.of(pieces)
    typical = np.bincount(layout.row, weight, int(layout.bounds[-1]) + 1)
    return Speller(layout, Attention(layout.bounds).init(typical, seed), int(pieces.sum()))


def blocks(w: Words, rng: np.random.Generator, share: float) -> tuple[Words, np.ndarray, np.ndarray]:
    """A random ``share`` of the blocks of ``BLOCK_WORDS`` words of all texts, as texts of their own; which open and which close their text."""
    n = np.maximum(1, -(-w.counts // BLOCK_WORDS))
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    pick = rng.random(len(text)) < share
    text, place = text[pick], place[pick]
    lo = w.first[text] + place * BLOCK_WORDS
    hi = np.minimum(lo + BLOCK_WORDS, w.first[text + 1])
    size = hi - lo
    first = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(first[-1]) + np.repeat(lo - first[:-1], size)
    return Words(0, w.data, w.starts[index], w.ends[index], first, first), place == 0, hi == w.first[text + 1]


def _dense(p: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters but the vectors of what is read, as rows of DIM values."""
    flat = np.concatenate([p[k].ravel() for k in sorted(p) if k != "E"]).astype(np.float64)
    return np.concatenate([flat, np.zeros(-len(flat) % DIM)]).reshape(-1, DIM)


def refine(texts: DataFrame, raw, sent, speller: Speller, share: float = STEP_SHARE, batch: int = 512, rate: float = 0.006) -> tuple[Speller, int]:
    """The model after a pass over all ``texts (id, text)``, and how many subwords of theirs it took steps on.

    Every task starts from the same model and takes steps on all of its texts, or on a random ``share`` of their blocks. A subword's vector moves by the mean of the
    tasks' moves, weighted by how often each has read it; the other parameters by the mean weighted by subwords. As many rows
    as the model has reach the driver, whatever the input.
    """
    model = texts.sparkSession.sparkContext.broadcast((speller.layout, speller.net.p))
    names = [f"d{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, begun = model.value
        net, subwords, counts = Attention(layout.bounds, {k: p.copy() for k, p in begun.items()}), Subwords.of(raw.value), sent.value
        steps, rng, reads, total = Steps(net), np.random.default_rng(1), np.zeros(len(begun["E"])), 0
        held: list[tuple] = []

        def learn(parts: tuple) -> None:
            read, target, weight = parts
            for at in range(0, len(read), batch):
                part = slice(at, at + batch)
                steps.take(read[part], target[part], weight[part], rate / (1 + steps.n / 100))

        for rows in batches:
            for w in slices(rows.column(1), True):
                some, opens, closes = blocks(w, rng, share) if share < 1 else (w, *np.ones((2, len(w.counts)), bool))
                if not len(some.counts):
                    continue
                t = subwords.tokens(some)
                weight = weights(t, counts, counts.rows_of(t.hashes))
                weight[t.text_first[:-1][~opens]] = 0  # what comes before a block is not read
                weight[t.text_first[1:][~closes] - 1] = 0  # a block inside a text has no end
                parts = windows(layout.row[t.ids], _spread(t, weight), t.first)
                reads += np.bincount(parts[0][parts[2] > 0], minlength=len(reads))
                total += int((parts[2] > 0).sum())
                held.append(parts)
                if sum(len(h[0]) for h in held) >= 4 * batch:
                    learn(tuple(map(np.concatenate, zip(*held))))
                    held = []
        if held:
            learn(tuple(map(np.concatenate, zip(*held))))
        if not total:
            return
        used, dense = np.flatnonzero(reads), _dense(net.p) - _dense(begun)
        key = np.concatenate([used, len(reads) + np.arange(len(dense))])
        weight = np.concatenate([reads[used], np.full(len(dense), float(total))])
        move = np.concatenate([net.p["E"][used].astype(np.float64) - begun["E"][used], dense]) * weight[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(weight), *[pa.array(c) for c in move.T.copy()]], ["key", "weight", *names])

    moves = texts.mapInArrow(run, "key long, weight double, " + ", ".join(f"{n} double" for n in names))
    moves = moves.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("weight", *names)]).toArrow()
    if not len(moves):
        return speller, 0
    key, weight = moves["key"].to_numpy(), moves["weight"].to_numpy()
    move = np.stack([moves[n].to_numpy() for n in names], axis=1) / weight[:, None]
    p = {k: x.copy() for k, x in speller.net.p.items()}
    own, rows, dense, at = key < len(p["E"]), len(p["E"]), _dense(p), 0
    p["E"][key[own]] += move[own].astype(np.float32)
    dense[key[~own] - rows] += move[~own]
    for k in sorted(p):
        if k != "E":
            p[k] = dense.ravel()[at : at + p[k].size].reshape(p[k].shape).astype(np.float32)
            at += p[k].size
    return Speller(speller.layout, Attention(speller.layout.bounds, p), speller.size), int(weight[~own].max())


def learn_all(texts: DataFrame, raw, sent, speller: Speller) -> Speller:
    """The model after steps on all of all ``texts (id, text)``: first in parts by hash, so that tasks soon start from a common model, then whole again where they are few."""
    mark, low = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)), 0.0
    for share, batch, rate in PARTS:
        part = texts.where((mark >= int(low * (1 << 20))) & (mark < int((low + share) * (1 << 20))))
        speller, low = refine(part, raw, sent, speller, batch=batch, rate=rate)[0], low + share
    for _ in range(min(PASSES, -(-LEAST_WINDOWS * WINDOW // max(speller.size, 1))) - 1):
        speller = refine(texts, raw, sent, speller, batch=128, rate=0.012)[0]
    return speller


def fit(learn: DataFrame, raw, sent_words: int = SENT_WORDS, start_texts: int = START_TEXTS) -> tuple[DataFrame, Counts, Speller]:
    """``(words (key, n), counts, speller)`` from the training texts ``learn (id, text)``."""
    spark = learn.sparkSession
    topics = topics_of(learn, start_texts=start_texts)
    every = durable(counts_of(learn, topics), "word-counts")
    by_topic = [f"t{k}" for k in range(len(topics))]
    each = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(by_topic)]
    words = durable(every.where(F.col("kind").between(0, _TEXTS - 1)).groupBy("key").agg(F.sum("n").alias("n"), *each), "words")
    columns = [*by_topic, "n"]
    sums = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in columns], *[F.count(F.when(F.col(c) > 0, 1)) for c in columns]).first()
    few, ends = every.where(F.col("kind") >= _TEXTS).toArrow(), np.zeros(len(columns))  # a row a topic
    ends[few["kind"].to_numpy() - _TEXTS] = few["n"].to_numpy()
    ends[-1] = ends.sum()
    key, table = _commonest(words, sent_words, columns)
    counts = Counts.of(key, np.concatenate([table, ends[None]]), np.array(sums[: len(columns)], float) + ends, np.array(sums[len(columns) :], float) + (ends > 0))
    sent = spark.sparkContext.broadcast(counts)
    speller = learn_all(learn, raw, sent, start(learn, raw, sent))
    sent.unpersist()
    return words, counts, speller


def score(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_path: str = VOCABULARY,
    sent_words: int = SENT_WORDS,
    start_texts: int = START_TEXTS,
) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` for every row, learning from rows where ``training``.

    Texts are lower-cased (A-Z); words and one end are the base's tokens, with add-one counts over the training rows.
    ``score`` is the model's log10 probability of the words and the end. Null texts are
    empty; repeated rows count and score each by itself. Word and subword counts and topics cover all training rows, and the
    model takes steps on windows of all of them; only the centres that topics begin with come from at most
    ``start_texts`` training texts. Of words beyond the ``sent_words`` commonest the model knows no count, but spells them.
    """
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(vocabulary(vocabulary_path, spark))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), training.alias("training"))
    words, counts, speller = fit(rows.where("training").select("id", "text"), raw, sent_words, start_texts)
    total, distinct, ends = int(counts.all_tokens[-1]), int(counts.all_words[-1]), rows.where("training").count()
    sent = spark.sparkContext.broadcast((counts, speller.layout, speller.net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, layout, p = sent.value
        speller, subwords = Speller(layout, Attention(layout.bounds, p)), Subwords.of(raw.value)
        logs, n = np.log10(counts.n + 1.0), len(counts.key)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for w in slices(batch.column(1), True):
                t = subwords.tokens(w)
                at = counts.rows_of(t.hashes)
                of_word, texts = at[t.unit], len(w.counts)
                known = of_word < n
                text_of = np.repeat(np.arange(texts), w.counts + 1)
                out[0].append(w.counts + 1)
                out[1].append(np.bincount(text_of[known], minlength=texts))
                out[2].append(np.bincount(text_of[known], logs[of_word[known]], texts))
                out[3].append(mixture(t, speller.spell(t), counts, at))
                other = of_word == n + 1
                hashes = np.append(t.hashes, np.uint64(0))[t.unit[other]].view(np.int64)
                out[4] += np.split(hashes, np.cumsum(np.bincount(text_of[other], minlength=texts))[:-1])
            flat = [np.concatenate(c) if c else np.zeros(0) for c in out[:4]]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            columns = [pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(flat, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(out[4], pa.list_(pa.int64()))], ["id", "n_tokens", "n_sent", "logs", "score", "rare"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.select("id", "text").mapInArrow(run, f"id {kind}, n_tokens long, n_sent long, logs double, score double, rare array<long>")
    scored = durable(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    rare = rare.join(words.select("key", "n"), "key")  # words that training has not seen add log10(0 + 1)
    rare = rare.groupBy("row").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"))
    out = scored.drop("rare").join(rare, "row", "left")
    base = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + F.lit(float(np.log10(ends + 1.0)))
    return out.select(
        "id",
        "n_tokens",
        (F.col("n_sent") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (base - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1.0)))).alias("base_score"),
        "score",
    )
