"""One layer of causal self-attention over subword ids with a two-level softmax over subwords, in numpy.

Subwords are rows in the order of their counts; the ``len(Out)`` most frequent have vectors of their own, the others share the last
row and are told apart by their counts. The output first picks a class (a range of rows), then the subword in it; both
depend on what attention has read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DIM, WINDOW, STEP, CLASSES = 24, 16, 14, 64
#: Subwords with vectors of their own.
NEAR = 4096


@dataclass
class Layout:
    """Rows of subwords: ``row`` of every id, where the classes begin, and ln P(id | the shared row)."""

    row: np.ndarray
    bounds: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Layout:
        order = np.argsort(-counts, kind="stable")
        near = max(1, min(NEAR, int((counts > 0).sum()), len(counts) - 1))
        row = np.full(len(counts), near)
        row[order[:near]] = np.arange(near)
        weight = np.cumsum(np.sqrt(counts[order[:near]] + 1.0))
        bounds = np.searchsorted(weight, weight[-1] * np.arange(1, CLASSES) / CLASSES)
        rest = np.where(row == near, counts + 0.1, 0.0)
        return cls(row, np.unique(np.concatenate([[0], bounds, [near]])), np.log(np.maximum(rest, 1e-9) / rest.sum()) * (row == near))


@dataclass
class Attention:
    bounds: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)
    _table: np.ndarray | None = None  # set by ready(), for scoring
    _places: np.ndarray | None = None
    _kinds: np.ndarray | None = None  # class of every row
    _steep_places: bool = True
    _steep_outputs: bool = True

    def init(self, counts: np.ndarray, seed: int = 1) -> Attention:
        """``counts`` of the rows, the shared row last; they set where the output begins."""
        rng, near, n = np.random.default_rng(seed), len(counts) - 1, len(self.bounds)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        smooth = counts + 0.1
        self.p = {"E": normal(0.3, near + 1, DIM), "P": normal(0.1, WINDOW, DIM), "W": normal(0.25, DIM, 3 * DIM), "O": normal(0.25, DIM, DIM)}
        mass = np.append(np.add.reduceat(smooth[:near], self.bounds[:-1]), smooth[near])
        self.p |= {"C": normal(0.25, DIM, n), "c": np.log(mass / mass.sum()).astype(np.float32)}
        self.p |= {"Out": normal(0.1, near, DIM), "b": np.log(smooth[:near] / np.repeat(mass[:-1], np.diff(self.bounds))).astype(np.float32)}
        return self

    def states(self, rows: np.ndarray, keep: dict) -> np.ndarray:
        """What every place knows of the next subword; ``rows`` (windows, WINDOW) are what is read. ``keep`` gets what gradients need."""
        used = np.flatnonzero(np.bincount(rows.ravel(), minlength=len(self.p["E"])))
        at = np.empty(len(self.p["E"]), np.int64)
        at[used] = np.arange(len(used))
        seen, at = self.p["E"][used], np.take(at, rows)
        m = np.take(seen @ self.p["W"], at, axis=0)  # a subword that is read often is multiplied once
        m += self.p["P"] @ self.p["W"]
        q, k, v = (m[:, :, i * DIM : (i + 1) * DIM] for i in range(3))
        s = np.matmul(q, k.transpose(0, 2, 1)) * np.float32(DIM**-0.5)
        a = np.exp(np.minimum(s, 30)) * np.tri(WINDOW, dtype=s.dtype)
        a /= a.sum(axis=2, keepdims=True)
        o = np.matmul(a, v)
        keep |= {"used": used, "seen": seen, "at": at, "q": q, "k": k, "v": v, "a": a, "o": o, "s": s}
        return np.tanh(o.reshape(-1, DIM) @ self.p["O"] + v.reshape(-1, DIM))  # the subword itself, besides what it attends to

    def ready(self) -> Attention:
        """Tables for scoring: queries, keys, values of what is read and a column of ones, whose sum is what attention divides by."""
        if self._table is None:
            p, scale = self.p, np.repeat(np.float32([DIM**-0.5, 1, 1]), DIM)
            wide = [np.concatenate([x @ p["W"] * scale, np.full((len(x), 1), one, np.float32)], axis=1) for x, one in ((p["E"], 1), (p["P"], 0))]
            self._table, self._places = (np.ascontiguousarray(w, np.float32) for w in wide)
            most = lambda part: np.linalg.norm(part, axis=1).max()
            bound = [most(self._table[:, c]) + most(self._places[:, c]) for c in (slice(0, DIM), slice(DIM, 2 * DIM))]
            self._steep_places, self._steep_outputs = bool(bound[0] * bound[1] > 60), self._steep()
        return self

    def _steep(self) -> bool:
        """Whether outputs can be too large for exponentials in 32 bits; states are between -1 and 1."""
        return max(float((np.abs(self.p[v]).sum(axis=axis) + np.abs(self.p[b])).max(initial=0)) for v, b, axis in (("C", "c", 0), ("Out", "b", 1))) > 60

    def read_states(self, rows: np.ndarray, lo: int) -> np.ndarray:
        """The same as ``states`` from place ``lo`` on, without gradients."""
        m = np.take(self._table, rows, axis=0)  # much faster than indexing
        m += self._places
        a = np.matmul(m[:, lo:, :DIM], m[:, :, DIM : 2 * DIM].transpose(0, 2, 1))
        if self._steep_places:
            np.minimum(a, 30, out=a)
        np.exp(a, out=a)
        a *= np.tri(WINDOW, dtype=a.dtype)[lo:]
        o = np.matmul(a, m[:, :, 2 * DIM :]).reshape(-1, DIM + 1)
        h = (o[:, :DIM] / o[:, DIM:]) @ self.p["O"]
        h += m[:, lo:, 2 * DIM : 3 * DIM].reshape(-1, DIM)
        return np.tanh(h, out=h)

    def log_p(self, h: np.ndarray, target: np.ndarray, back: tuple[np.ndarray, dict] | None = None) -> np.ndarray:
        """ln P(row ``target``) for every state. ``back``: weights, and a place for gradients of -sum(weights * ln P)."""
        p, n, steep = self.p, len(self.bounds), self._steep() if self._table is None else self._steep_outputs
        if self._kinds is None:
            self._kinds = (np.searchsorted(self.bounds, np.arange(self.bounds[-1] + 1), side="right") - 1).astype(np.uint8)
        kind = np.take(self._kinds, target)
        order = np.argsort(kind, kind="stable")
        h, target, kind = np.take(h, order, axis=0), np.take(target, order), np.take(kind, order)
        edges = np.searchsorted(kind, np.arange(n + 1))
        z = h @ p["C"]
        z += p["c"]
        weight = None if back is None else back[0][order]
        value = self._soft(z, kind, steep, weight)
        if back is not None:
            g = back[1]
            g |= {"C": h.T @ z, "c": z.sum(axis=0), "Out": np.zeros_like(p["Out"]), "b": np.zeros_like(p["b"])}
            dh = z @ p["C"].T
        for c in range(n - 1):
            mine = slice(edges[c], edges[c + 1])
            if mine.start == mine.stop:
                continue
            a, b = self.bounds[c], self.bounds[c + 1]
            y = h[mine] @ p["Out"][a:b].T
            y += p["b"][a:b]
            value[mine] += self._soft(y, target[mine] - a, steep, None if weight is None else weight[mine])
            if back is not None:
                g["Out"][a:b], g["b"][a:b] = y.T @ h[mine], y.sum(axis=0)
                dh[mine] += y @ p["Out"][a:b]
        out = np.empty_like(value)
        out[order] = value
        if back is not None:
            g["h"] = np.empty_like(dh)
            g["h"][order] = dh
        return out

    @staticmethod
    def _soft(z: np.ndarray, at: np.ndarray, steep: bool, weight: np.ndarray | None = None) -> np.ndarray:
        """ln of the softmax of every row at ``at``. With ``weight``, ``z`` becomes the gradients of -sum(weight * ln)."""
        if steep:
            z -= z.max(axis=1, keepdims=True)
        place = np.arange(len(z))
        picked = z[place, at]
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[1], z.dtype)
        if weight is not None:
            z *= (weight / total)[:, None]
            z[place, at] -= weight
        return picked - np.log(total)

    def gradients(self, rows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
        """Of the mean cross entropy by ``weight``; E as (rows that are read, gradients)."""
        t: dict = {}
        h, g = self.states(rows, t), {}
        scaled = (weight / max(float(weight.sum()), 1e-9)).astype(h.dtype).ravel()
        some = np.flatnonzero(scaled)  # places beyond a text have no loss
        dpre, told = np.zeros_like(h), np.take(h, some, axis=0)
        self.log_p(told, np.take(target.ravel(), some), (scaled[some], g))
        dpre[some] = g.pop("h") * (1 - told * told)
        dpre = dpre.reshape(*rows.shape, DIM)
        g["O"] = t["o"].reshape(-1, DIM).T @ dpre.reshape(-1, DIM)
        do = dpre @ self.p["O"].T
        da = np.matmul(do, t["v"].transpose(0, 2, 1))
        da -= np.einsum("wij,wij->wi", t["a"], da)[:, :, None]
        ds = da * t["a"]
        ds *= np.float32(DIM**-0.5)
        if t["s"].max(initial=0) >= 30:
            ds *= t["s"] < 30
        dv = np.matmul(t["a"].transpose(0, 2, 1), do) + dpre
        dm = np.concatenate([np.matmul(ds, t["k"]), np.matmul(ds.transpose(0, 2, 1), t["q"]), dv], axis=2)
        order = np.argsort(t["at"].ravel().astype(np.uint16), kind="stable")
        ids = np.take(t["at"].ravel(), order)
        by_row = np.add.reduceat(np.take(dm.reshape(-1, 3 * DIM), order, axis=0), np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]), axis=0)
        by_place = dm.sum(axis=0)
        g["W"] = t["seen"].T @ by_row + self.p["P"].T @ by_place
        return g | {"P": by_place @ self.p["W"].T, "E": (t["used"], by_row @ self.p["W"].T)}

    def text_log_p(self, rows: np.ndarray, first: np.ndarray, chunk: int = 512, chunks: int = 8) -> np.ndarray:
        """ln P of every subword of texts end to end, from overlapping windows that score each once. A text is read from an end."""
        self.ready()
        read = np.concatenate([rows[-1:], rows[:-1]])
        if len(rows):
            read[first[:-1]] = rows[first[1] - 1]
        size, value = np.diff(first), np.zeros(len(rows))
        for lo in (0, WINDOW - STEP):
            if lo == 0:
                text, start = np.arange(len(size)), np.zeros(len(size), np.int64)
            else:
                n = np.maximum(0, -(-(size - WINDOW) // STEP))
                text = np.repeat(np.arange(len(size)), n)
                start = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + 1) * STEP
            begin, end = first[:-1][text] + start, first[1:][text]
            for far in range(0, len(text), chunk * chunks):
                states, targets = [], []
                for at in range(far, min(far + chunk * chunks, len(text)), chunk):
                    place = begin[at : at + chunk, None] + np.arange(WINDOW)
                    live = place[:, lo:] < end[at : at + chunk, None]
                    place = np.minimum(place, len(rows) - 1)
                    h, target = self.read_states(np.take(read, place), lo), place[:, lo:].ravel()
                    if not live.all():
                        h, target = h[live.ravel()], target[live.ravel()]
                    states.append(h)
                    targets.append(target)
                target = np.concatenate(targets)
                value[target] = self.log_p(np.concatenate(states), np.take(rows, target))
        return value


class Steps:
    """Gradient steps: Adam, and AdaGrad for the vectors of subwords."""

    def __init__(self, model: Attention) -> None:
        self.model, self.n = model, 0
        self.moment = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in model.p.items()}

    def take(self, rows: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> None:
        self.n += 1
        for name, g in self.model.gradients(rows, target, weight).items():
            p, (m, s) = self.model.p[name], self.moment[name]
            if name == "E":
                ids, g = g
                s[ids] += g * g
                p[ids] -= 5 * rate * g / (np.sqrt(s[ids]) + 1e-6)
            elif name in ("Out", "b"):
                s += g * g
                p -= 5 * rate * g / (np.sqrt(s) + 1e-6)
            else:
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**self.n)) / (np.sqrt(s / (1 - 0.99**self.n)) + 1e-8)


def windows(rows: np.ndarray, weight: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(read, target, weight)`` of all training windows of texts end to end; places beyond a text weigh nothing."""
    size = np.diff(first)
    n = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), n)
    begin = first[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    place = begin[:, None] + np.arange(WINDOW)
    live = place < first[1:][text][:, None]
    place = np.minimum(place, max(0, len(rows) - 1))
    read = np.concatenate([rows[-1:], rows[:-1]])
    if len(rows):
        read[first[:-1]] = rows[first[1] - 1]
    return read[place], rows[place], weight[place] * live
