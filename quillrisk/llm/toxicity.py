"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters the network as its own vector plus the mean of its character n-gram vectors (hashed 3- and
4-grams with both word ends), so that unseen forms of a stem are known. Texts are read in overlapping
windows of words; each window is pooled by attention and a text scores as its worst window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrisk.llm._tasks import in_one_task
from quillrisk.llm._tokens import SPACE, Words, slices

WINDOW, STEP = 32, 16
DIM, HIDDEN = 16, 8
WORD_ROWS, GRAM_ROWS = 1 << 15, 1 << 16
_BREAKS = SPACE.copy()
_BREAKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Vocabulary:
    """Distinct words of some texts: rows of their word vectors and, end to end, of their n-grams'."""

    word: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    index: np.ndarray  # of every word of the texts


def _vocabulary(w: Words) -> Vocabulary:
    hashes, at, index = np.unique(w.hashes(), return_index=True, return_inverse=True)
    starts, size = w.starts[at], (w.ends - w.starts)[at]
    # The distinct words end to end as ^word$.
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    line = np.full(begin[-1], ord("^"), np.uint32)
    inner = np.ones(len(line), bool)
    inner[begin[:-1]] = inner[begin[1:] - 1] = False
    line[begin[1:] - 1] = ord("$")
    line[inner] = w.data[np.arange(size.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size)]
    codes, owners = [], []
    owner = np.repeat(np.arange(len(size)), size + 2)
    for n in (3, 4):
        if len(line) < n:
            continue
        code = np.full(len(line) - n + 1, n, np.uint32)
        for j in range(n):
            code = (code ^ line[j : j + len(code)]) * np.uint32(0x01000193)
            code ^= code >> np.uint32(15)
        inside = owner[: len(code)] == owner[n - 1 :]
        codes.append((code * np.uint32(0x9E3779B1) >> np.uint32(16))[inside])
        owners.append(owner[: len(code)][inside])
    if not codes:
        return Vocabulary(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), index)
    owner, code = np.concatenate(owners), np.concatenate(codes)
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(len(size) + 1))
    return Vocabulary((hashes >> np.uint64(49)).astype(np.int64), code[order].astype(np.int64), first, index)


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word (in its text) of every window; a text without words has one empty window."""
    n = np.maximum(1, 1 + -(-(counts - WINDOW) // STEP))
    text = np.repeat(np.arange(len(counts)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STEP


@dataclass
class Network:
    seed: int = 1
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.p:
            rng = np.random.default_rng(self.seed)
            normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
            self.p = {"words": normal(0.1, WORD_ROWS, DIM), "grams": normal(0.3, GRAM_ROWS, DIM)}
            for d in "fb":
                self.p |= {f"W{d}": normal(0.3, DIM, 3 * HIDDEN), f"U{d}": normal(0.3, HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
            self.p |= {"v": normal(0.3, 2 * HIDDEN), "w": normal(0.3, 2 * HIDDEN), "b": np.full(1, -0.5, np.float32)}
            self.p |= {"shift": np.zeros(1)}

    def inputs(self, v: Vocabulary) -> np.ndarray:
        """Vectors of distinct words."""
        if not len(v.word):
            return np.zeros((0, DIM), np.float32)
        out, most = self.p["words"][v.word], 1 << 15
        for at in range(0, len(out), most):
            first = v.first[at : at + most + 1]
            sums = np.add.reduceat(self.p["grams"][v.grams[first[0] : first[-1]]], first[:-1] - first[0], axis=0)
            out[at : at + most] += sums / np.diff(first)[:, None]
        return out

    def _run(self, x: np.ndarray, here: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction. ``x``: projected inputs (time, window, 3 * HIDDEN); ``here``: which words exist."""
        u, h = self.p[f"U{d}"], np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((x.shape[0], x.shape[1], HIDDEN), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            hu = h @ u
            gates = _sigmoid(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = c + z * (h - c)
            new = np.where(here[t][:, None], new, h)
            if keep is not None:
                keep.append((t, z, r, c, hu[:, 2 * HIDDEN :], h))
            out[t] = h = new
        return out

    def logits(self, table: dict[str, np.ndarray], index: np.ndarray, here: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Of windows: ``index`` (time, window) into ``table``, the projected inputs of both directions."""
        kept = {d: [] if keep is not None else None for d in "fb"}
        h = np.concatenate([self._run(table[d][index], here, d, kept[d]) for d in "fb"], axis=2)
        s = np.where(here, h @ self.p["v"], -1e9)
        a = np.exp(s - s.max(axis=0)) * here
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tw,twh->wh", a, h)
        if keep is not None:
            keep |= {"steps": kept, "h": h, "a": a, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"][0]

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: np.concatenate([x, np.zeros((1, DIM), np.float32)]) @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def windows(self, w: Words, v: Vocabulary, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Text and logit of every window of a slice."""
        table = self.project(self.inputs(v))
        text, start = _windows(w.counts)
        out = np.empty(len(text), np.float32)
        for at in range(0, len(text), chunk):
            index, here = _window_words(w, v, text[at : at + chunk], start[at : at + chunk])
            out[at : at + chunk] = self.logits(table, index, here)
        return text, out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A score for every text: its worst window's."""
        out = np.zeros(len(texts))
        for w in slices(texts, True, max_bytes=1 << 22, breaks=_BREAKS):
            text, logit = self.windows(w, _vocabulary(w))
            worst = np.full(len(w.first) - 1, -np.inf, np.float32)
            np.maximum.at(worst, text, logit)
            out[w.row : w.row + len(worst)] = _sigmoid(worst.astype(np.float64) - self.p["shift"][0])
        return out

    def calibrate(self, texts: pa.Array, toxic: np.ndarray, at: float) -> None:
        """Shift the scores so that ``at`` parts texts that training has not seen with the fewest errors."""
        raw = np.clip(self.scores(texts), 1e-12, 1 - 1e-12)
        logit = np.log(raw / (1 - raw))
        order = np.argsort(logit)
        errors = np.concatenate([[0], np.cumsum(np.where(toxic[order] == 1, 1, -1))])
        cuts = np.concatenate([[logit[order[0]] - 1], (logit[order][1:] + logit[order][:-1]) / 2, [logit[order[-1]] + 1]])
        best = cuts[errors == errors.min()]
        self.p["shift"] = self.p["shift"] + (best.min() + best.max()) / 2 - np.log(at / (1 - at))

    def gradients(self, v: Vocabulary, x: np.ndarray, index: np.ndarray, here: np.ndarray, y: np.ndarray) -> dict[str, tuple]:
        """Of the mean cross entropy; embeddings as (rows, gradients)."""
        keep: dict = {}
        table = self.project(x)
        delta = ((_sigmoid(self.logits(table, index, here, keep)) - y) / len(y)).astype(np.float32)
        h, a, pooled = keep["h"], keep["a"], keep["pooled"]
        dpooled = delta[:, None] * self.p["w"]
        da = np.einsum("wh,twh->tw", dpooled, h)
        ds = a * (da - (a * da).sum(axis=0))
        dh = a[:, :, None] * dpooled + ds[:, :, None] * self.p["v"]
        out: dict = {"w": pooled.T @ delta, "b": delta.sum(keepdims=True), "v": np.einsum("tw,twh->h", ds, h)}
        dx = np.zeros((len(x) + 1, DIM), np.float32)
        for k, d in enumerate("fb"):
            own, carry = dh[:, :, k * HIDDEN : (k + 1) * HIDDEN], np.zeros((len(y), HIDDEN), np.float32)
            du, dsteps = np.zeros_like(self.p[f"U{d}"]), np.zeros((*index.shape, 3 * HIDDEN), table[d].dtype)
            for t, z, r, c, huc, before in reversed(keep["steps"][d]):
                g = own[t] + carry
                m = here[t][:, None]
                live = g * m
                dz, dc = live * (before - c) * z * (1 - z), live * (1 - z) * (1 - c * c)
                dr, dhu = dc * huc * r * (1 - r), dc * r
                dsteps[t] = np.concatenate([dz, dr, dc], axis=1)
                back = np.concatenate([dz, dr, dhu], axis=1)
                du += before.T @ back
                carry = g * ~m + live * z + back @ self.p[f"U{d}"].T
            dtable = np.zeros_like(table[d])
            rows, sums = _sum_by(index.ravel(), dsteps.reshape(-1, 3 * HIDDEN))
            dtable[rows] = sums
            out |= {f"U{d}": du, f"c{d}": dtable.sum(axis=0), f"W{d}": x.T @ dtable[:-1]}
            dx += dtable @ self.p[f"W{d}"].T
        dx = dx[:-1]
        out["words"] = (v.word, dx)
        out["grams"] = (v.grams, np.repeat(dx / np.diff(v.first)[:, None], np.diff(v.first), axis=0))
        return out


def _sum_by(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``rows`` and the sums of their ``values``."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[first], np.add.reduceat(values[order], first, axis=0)


def _window_words(w: Words, v: Vocabulary, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = start[None, :] + np.arange(WINDOW)[:, None]
    here = place < w.counts[text][None, :]
    at = np.minimum(w.first[text][None, :] + place, max(0, len(v.index) - 1))
    return np.where(here, v.index[at] if len(v.index) else 0, len(v.word)), here


def _pick(v: Vocabulary, index: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
    """The words of ``index`` alone, and ``index`` into them; the missing word stays last."""
    used, new = np.unique(np.append(index.ravel(), len(v.word)), return_inverse=True)
    used, new = used[:-1], new[:-1]
    size = np.diff(v.first)[used]
    first = np.concatenate([[0], np.cumsum(size)])
    grams = v.grams[np.arange(first[-1]) + np.repeat(v.first[used] - first[:-1], size)]
    return Vocabulary(v.word[used], grams, first, new), new.reshape(index.shape)


def _shared_rows(w: Words, v: Vocabulary) -> dict[str, np.ndarray]:
    """Which rows of the word and n-gram vectors at least two texts use."""
    seen = {"words": (v.word, WORD_ROWS), "grams": (v.grams, GRAM_ROWS)}
    sizes = np.diff(v.first)
    low, high = ({k: np.full(n, fill) for k, (_, n) in seen.items()} for fill in (np.iinfo(np.int64).max, -1))
    for text, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
        word = np.unique(v.index[a:b])
        size = sizes[word]
        at = np.arange(size.sum()) + np.repeat(v.first[word] - (np.cumsum(size) - size), size)
        for name, rows in (("words", v.word[word]), ("grams", v.grams[at])):
            low[name][rows] = np.minimum(low[name][rows], text)
            high[name][rows] = text
    return {k: high[k] > low[k] for k in seen}


def train(
    texts: pa.Array, toxic: np.ndarray, rounds: int = 4, batch: int = 512, rate: float = 0.05, embedding_rate: float = 5.0, seed: int = 1, first_windows: int = 20_000, clean_windows: int = 6_000
) -> Network:
    """Fit on labelled texts. First all windows carry their text's label; then, round by round, toxic
    texts keep their worst windows alone and clean texts send their worst ones besides random ones.

    Steps are bounded: the first round takes at most ``first_windows`` windows of toxic texts, drawn at random, and every round
    ``clean_windows`` random ones of clean texts, or two for each toxic one if that is more.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    (w,) = slices(texts, True, max_bytes=1 << 40, breaks=_BREAKS)
    v = _vocabulary(w)
    text, start = _windows(w.counts)
    label = toxic[text].astype(np.float32)
    clean, bad = np.flatnonzero(label == 0), np.flatnonzero(label == 1)
    # Vectors of words and n-grams that a single text holds would only learn that text by heart: they stay zero.
    live = _shared_rows(w, v)
    for name, rows in live.items():
        net.p[name][~rows] = 0
    squares = {k: np.full_like(p, 1e-6) for k, p in net.p.items()}
    for k in range(rounds):
        logit = net.windows(w, v)[1] if k else rng.normal(size=len(text))
        order = np.lexsort((-logit, text))
        worst = order[np.r_[True, text[order][1:] != text[order][:-1]]]
        if k == 0:
            positive = rng.permutation(bad)[:first_windows]
        else:
            top = np.full(toxic.shape, -np.inf, np.float32)
            top[text[worst]] = logit[worst]
            positive = bad[logit[bad] >= np.maximum(top[text[bad]] - 0.5, -30)]
        hard = worst[label[worst] == 0] if k else worst[:0]
        second = clean[logit[clean] > np.quantile(logit[hard], 0.9)] if len(hard) else hard  # windows as bad as the worst texts'
        negative = np.concatenate([rng.permutation(clean)[: max(clean_windows, 2 * len(positive))], hard, hard, second])
        positive = np.tile(positive, max(1, len(negative) // max(1, 2 * len(positive))))
        chosen = np.concatenate([positive, negative])
        passes = max(1, -(-40 * batch // len(chosen)))  # few texts are gone through more often
        chosen = np.concatenate([rng.permutation(chosen) for _ in range(passes)])
        for at in range(0, len(chosen), batch):
            mine = chosen[at : at + batch]
            index, here = _window_words(w, v, text[mine], start[mine])
            part, index = _pick(v, index)
            for name, g in net.gradients(part, net.inputs(part), index, here, label[mine]).items():
                p, s = net.p[name], squares[name]
                if isinstance(g, tuple):
                    # One step size for all rows: rows that many texts share learn, those of single texts hardly do.
                    rows, sums = _sum_by(*g)
                    p[rows] -= embedding_rate * len(mine) * sums * live[name][rows][:, None]
                else:
                    s += g * g
                    p -= rate * g / np.sqrt(s)
    return net


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs_per_class: int = 1000, clean_for_toxic: int = 3, at: float = 0.7
) -> Network | None:
    """A network from at most ``docs_per_class`` toxic rows and ``clean_for_toxic`` times as many clean ones
    (least hashes of their ids).

    Every fifth of them is kept from training and sets the scores' scale: ``at`` is where the classes part.
    None if a class has no row. Labels that are null or contradict each other are left out.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.min(label_col).alias("low"), F.max(label_col).alias("high")).where("low = high")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = texts.select("id").distinct()
    # Learning is bounded; each class's rows are the first by hash, found by a top-k.
    parts = [known.join(ids, "id", "left_semi").where(F.col("low") == c).orderBy(F.xxhash64("id"), "id").limit(docs_per_class * (1 if c else clean_for_toxic)) for c in (0, 1)]
    chosen = parts[0].union(parts[1]).select("id", F.col("low").alias("label"))

    def learn(got: pa.Table | None) -> dict | None:
        if got is None:
            return None
        got = got.take(pa.array(np.lexsort((got["text"].to_numpy(), got["id"].to_numpy()))))
        net = _fit_sample(got["text"].combine_chunks(), got["label"].to_numpy(), at)
        return net and net.p

    # The sample is bounded, so one task trains on it, away from the driver; the network has a fixed size.
    p = in_one_task(texts.join(chosen, "id").select("id", "text", F.col("label").cast("int").alias("label")), learn)
    return Network(p=p) if p else None


def _fit_sample(texts: pa.Array, label: np.ndarray, at: float) -> Network | None:
    """Train on four fifths of a sample and calibrate on the rest."""
    if not 0 < label.sum() < len(label):
        return None
    apart = np.arange(len(label)) % 5 == 4
    if not 0 < label[~apart].sum() < (~apart).sum() or not 0 < label[apart].sum() < apart.sum():
        return train(texts, label)
    net = train(texts.filter(pa.array(~apart)), label[~apart])
    net.calibrate(texts.filter(pa.array(apart)), label[apart], at)
    return net


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row, from whole texts in overlapping windows; 0 without a network.

    Null, empty and wordless texts score as the network's empty window. Repeated rows get equal scores.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if net is None:
        return rows.select("id", F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(net.p)  # a fixed size, about 1.6 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(p=sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, net: Network | None, text_col: str = "text", at: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``at``, with all their columns; all rows without a network."""
    if net is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(net.p)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(p=sent.value)
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(place).cast(pa.string())) < at))

    return docs.mapInArrow(run, docs.schema)
