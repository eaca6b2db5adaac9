"""Boosted regression trees with monotone bounds: histograms of gradients by Spark, splits from the histograms.

Rows of equal bins become one row of sums before the first tree, so that the trees read as many rows as there are combinations of bins. A
level of a tree is one Spark job: tasks add up the rows and residuals of every node, feature and bin, Spark adds those of the tasks, and the driver
gets a table of nodes x features x bins, whatever the number of rows. A trained ensemble is a table of nodes and is scored from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrisk.operators.totals import average_ranks
from quillrisk.session import durable

NODES = "tree int, node int, feature int, threshold double, left_child int, right_child int, value double"
#: Rows that are scored at a time.
AT_ONCE = 2048


@dataclass
class Trees:
    """Trees as arrays of nodes: a value goes left where it is at most the threshold, nulls too; leaves have feature -1. The score is the sum of the leaves plus ``base``."""

    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    base: float = 0.0

    def add(self, nodes: list[tuple[int, float, int, int, float]]) -> None:
        """A tree of ``(feature, threshold, left, right, value)``, the root first, children by their places in the list."""
        at, columns = len(self.feature), list(zip(*nodes))
        self.roots = np.append(self.roots, at)
        self.feature, self.threshold, self.value = (np.append(x, np.array(c, x.dtype)) for x, c in ((self.feature, columns[0]), (self.threshold, columns[1]), (self.value, columns[4])))
        self.left, self.right = (np.append(x, np.array(c, np.int64) + at) for x, c in ((self.left, columns[2]), (self.right, columns[3])))

    def first(self, n: int) -> Trees:
        end = int(self.roots[n]) if n < len(self.roots) else len(self.feature)
        return Trees(self.roots[:n], self.feature[:end], self.threshold[:end], self.left[:end], self.right[:end], self.value[:end], self.base)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node of every row (rows of ``x``) in every tree."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while (inner := self.feature[at] >= 0).any():
            values = x[rows, np.maximum(self.feature[at], 0)]
            down = np.where(values > self.threshold[at], self.right[at], self.left[at])  # nan goes left
            at = np.where(inner, down, at)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        parts = [self.value[self.leaves(x[i : i + AT_ONCE])].sum(axis=1) for i in range(0, len(x), AT_ONCE)]
        return self.base + (np.concatenate(parts) if parts else np.zeros(0))

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each node (numbered within its tree); tree -1 holds the base."""
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1
        start = self.roots[tree] if len(tree) else tree
        local = lambda c: np.where(self.feature >= 0, c - start, -1)
        columns = {"tree": tree, "node": np.arange(len(tree)) - start, "feature": self.feature, "threshold": self.threshold, "left_child": local(self.left), "right_child": local(self.right), "value": self.value}
        rows = pd.DataFrame({k: np.append(v, {"tree": -1, "value": self.base}.get(k, 0)) for k, v in columns.items()})
        return spark.createDataFrame(rows.astype({"tree": "int32", "node": "int32", "feature": "int32", "left_child": "int32", "right_child": "int32"}), NODES)

    @classmethod
    def read(cls, table: DataFrame) -> Trees:
        """From a table of nodes, whose rows are as many as the model has nodes."""
        rows, out = table.toPandas().sort_values(["tree", "node"]), cls()
        out.base = float(rows.loc[rows["tree"] < 0, "value"].sum())
        for _, part in rows[rows["tree"] >= 0].groupby("tree"):
            out.add(list(part[["feature", "threshold", "left_child", "right_child", "value"]].itertuples(index=False, name=None)))
        return out


def score(trees: Trees, features: list[str]) -> Column:
    """The score of the columns ``features``, in Arrow batches; a null value goes left."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(trees.predict(np.column_stack([c.to_numpy(float) for c in batch])), index=batch[0].index)

    return run(*[F.col(f).cast("double") for f in features])


@dataclass
class Rules:
    """``monotone``: 1 (never falls), -1 (never rises) or 0 for each feature. ``patience``: trees without a better validation error until it stops."""

    monotone: tuple[int, ...]
    trees: int = 100
    depth: int = 3
    bins: int = 32
    rate: float = 0.2
    least: int = 20
    l2: float = 1.0
    patience: int = 10
    fold_every: int = 16


@dataclass
class Fitted:
    trees: Trees
    errors: list[float]  # mean squared validation error with no tree, one, two, ...
    gain: np.ndarray  # by feature


@dataclass
class Node:
    n: float
    g: float
    low: float = -np.inf
    high: float = np.inf
    split: tuple[int, int] | None = None  # feature and the last bin that goes left
    children: tuple[int, int] | None = None

    def value(self, l2: float) -> float:
        return float(np.clip(self.g / (self.n + l2), self.low, self.high)) if self.n + l2 > 0 else 0.0


def best_split(n: np.ndarray, g: np.ndarray, node: Node, rules: Rules) -> tuple[float, int, int] | None:
    """``(gain, feature, bin)`` of the split of a node with histograms ``n, g`` (features, bins) that lowers the loss most and keeps to the bounds."""
    left_n, left_g = n.cumsum(axis=1)[:, :-1], g.cumsum(axis=1)[:, :-1]
    right_n, right_g = node.n - left_n, node.g - left_g

    def side(n_: np.ndarray, g_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.clip(g_ / np.maximum(n_ + rules.l2, 1e-12), node.low, node.high)
        return v, v * (2 * g_ - (n_ + rules.l2) * v)

    (v_left, fall_left), (v_right, fall_right) = side(left_n, left_g), side(right_n, right_g)
    v = node.value(rules.l2)
    gain = fall_left + fall_right - v * (2 * node.g - (node.n + rules.l2) * v)
    sign = np.array(rules.monotone)[:, None]
    gain[(left_n < rules.least) | (right_n < rules.least) | (sign * (v_right - v_left) < 0)] = -np.inf
    at = int(np.argmax(gain)) if gain.size else 0
    if not gain.size or not gain.flat[at] > 1e-12:
        return None
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def _histograms(rows: DataFrame, more: Trees, tree: list[Node], open_: list[int], n_features: int, bins: int) -> tuple[np.ndarray, np.ndarray, tuple[float, float]]:
    """Counts and residuals ``(open nodes, features, bins)`` of the training rows, and ``(rows, squared error)`` of the validation rows.

    ``rows``: bins ``x``, ``later``, how many rows have them (``n``) and the sums of what is left to explain (``g``) and of its squares (``s``).
    """
    place = np.full(len(tree), -1)
    place[open_] = np.arange(len(open_))
    partial = Trees()
    partial.add([(x.split[0], x.split[1], *x.children, 0.0) if x.split else (-1, 0.0, 0, 0, 0.0) for x in tree])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, g = np.zeros(len(open_) * n_features * bins), np.zeros(len(open_) * n_features * bins)
        held = np.zeros(2)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_features).astype(np.int64)
            times, sums, squares = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            later, found = batch.column(4).to_numpy(zero_copy_only=False).astype(bool), more.predict(x)
            held += [times[later].sum(), (squares - 2 * found * sums + times * found**2)[later].sum()]
            node = place[partial.leaves(x)[:, 0]]
            mine = ~later & (node >= 0)
            key = ((node[mine, None] * n_features + np.arange(n_features)) * bins + x[mine]).ravel()
            n += np.bincount(key, np.repeat(times[mine], n_features), minlength=len(n))
            g += np.bincount(key, np.repeat((sums - times * found)[mine], n_features), minlength=len(g))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(n[some], held[0])), pa.array(np.append(g[some], held[1]))], ["cell", "n", "g"])

    found = rows.select("x", "n", "g", "s", "later").mapInArrow(run, "cell long, n double, g double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).toArrow()
    cell, n_, g_ = (found[c].to_numpy() for c in ("cell", "n", "g"))
    n, g = np.zeros(len(open_) * n_features * bins), np.zeros(len(open_) * n_features * bins)
    real = cell >= 0
    n[cell[real]], g[cell[real]] = n_[real], g_[real]
    shape = (len(open_), n_features, bins)
    return n.reshape(shape), g.reshape(shape), (float(n_[~real].sum()), float(g_[~real].sum()))


def fit(rows: DataFrame, features: list[str], target: str, later: str, rules: Rules) -> Fitted:
    """Trees for the percentile rank of ``target`` among the rows of the same side of the time split: rows where ``later`` are for validation alone.

    Bins are between approximate quantiles of the training rows. Leaves are kept within the bounds that splits on monotone features set, so
    scores never fall (or rise) along them. Training stops after ``patience`` trees without a better validation error and keeps the best number of
    trees; without validation rows it takes all. Rows without a target are left out, null features are in the lowest bin; without training rows
    there are no trees and the base is 0.
    """
    known = rows.where(F.col(target).isNotNull()).select(*[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)], F.col(target).alias("y"), F.coalesce(F.col(later), F.lit(False)).alias("later"))
    known = durable(known, "boosting-rows")
    sizes = {r["later"]: r["n"] for r in known.groupBy("later").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(False):
        return Fitted(Trees(), [], np.zeros(len(features)))
    edges = F.array(*[F.lit(k / rules.bins) for k in range(1, rules.bins)])
    row = known.where("NOT later").agg(*[F.percentile_approx(f"f{k}", edges, 10000).alias(f"f{k}") for k in range(len(features))]).first()
    cuts = [sorted(set(row[k] or []))[: rules.bins - 1] for k in range(len(features))]
    bins = rules.bins
    index = [_above(c, f"f{k}") for k, c in enumerate(cuts)]
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("later")]
    binned = known.select(*[x.alias(f"b{k}") for k, x in enumerate(index)], "y", "later").groupBy(*(names := [f"b{k}" for k in range(len(index))]), "y", "later")
    entries = durable(binned.agg(F.count("*").alias("n")), "boosting-entries")
    base = (sizes[False] + 1) / (2 * sizes[False])  # the mean of all ranks, whatever is equal
    rest = F.col("rank") / size - F.lit(base)
    ranked = average_ranks(entries, "later", "y", "rank", "n").withColumn("rest", rest).groupBy(*names, "later")
    sums = {"n": F.sum("n").cast("double"), "g": F.sum(F.col("n") * F.col("rest")), "s": F.sum(F.col("n") * F.col("rest") * F.col("rest"))}
    data = durable(ranked.agg(*[v.alias(k) for k, v in sums.items()]).select(F.array(*names).alias("x"), *sums, "later"), "boosting-bins")

    out, folded, errors, gain, best = Trees(base=base), 0, [], np.zeros(len(features)), 0
    for _ in range(rules.trees + 1):
        tree, open_, split = [Node(0.0, 0.0)], [0], False
        for level in range(rules.depth):
            counts, sums, held = _histograms(data, _since(out, folded), tree, open_, len(features), bins)
            if level == 0:
                errors.append(held[1] / held[0] if held[0] else float("nan"))
                tree[0].n, tree[0].g = float(counts[0, 0].sum()), float(sums[0, 0].sum())
                best = int(np.nanargmin(errors)) if held[0] else len(errors) - 1
                if len(out.roots) == rules.trees or len(errors) - 1 - best >= rules.patience:
                    break
            still = []
            for k, at in enumerate(open_):
                node = tree[at]
                found = best_split(counts[k], sums[k], node, rules)
                if not found:
                    continue
                gain[found[1]] += found[0]
                split = True
                node.split, node.children = found[1:], (len(tree), len(tree) + 1)
                left = Node(float(counts[k, found[1], : found[2] + 1].sum()), float(sums[k, found[1], : found[2] + 1].sum()), node.low, node.high)
                right = Node(node.n - left.n, node.g - left.g, node.low, node.high)
                middle = (left.value(rules.l2) + right.value(rules.l2)) / 2
                if rules.monotone[found[1]] > 0:
                    left.high, right.low = min(left.high, middle), max(right.low, middle)
                elif rules.monotone[found[1]] < 0:
                    left.low, right.high = max(left.low, middle), min(right.high, middle)
                still += node.children
                tree += [left, right]
            open_ = still
            if not open_:
                break
        if len(out.roots) == rules.trees or len(errors) - 1 - best >= rules.patience or not split:
            break
        out.add([(x.split[0], x.split[1], *x.children, 0.0) if x.split else (-1, 0.0, 0, 0, rules.rate * x.value(rules.l2)) for x in tree])
        if len(out.roots) - folded >= rules.fold_every:  # rows carry what is left to explain, so that old trees are not scored again
            scored, p = data.withColumn("p", _score_bins(_since(out, folded))), F.col("p")
            left = {"s": F.col("s") - 2 * p * F.col("g") + F.col("n") * p * p, "g": F.col("g") - F.col("n") * p}
            data = durable(scored.withColumns(left).drop("p"), "boosting-bins")
            folded = len(out.roots)
    kept = out.first(best)
    inner = kept.feature >= 0
    kept.threshold = kept.threshold.copy()
    kept.threshold[inner] = [cuts[f][int(b)] if int(b) < len(cuts[f]) else np.inf for f, b in zip(kept.feature[inner], kept.threshold[inner])]
    return Fitted(kept, errors, gain)


def _above(cuts: list[float], column: str) -> Column:
    """How many of ``cuts`` lie below the value: its bin."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda e: e < F.col(column)))


def _since(trees: Trees, n: int) -> Trees:
    """The trees from the ``n``-th on."""
    at = int(trees.roots[n]) if n < len(trees.roots) else len(trees.feature)
    return Trees(trees.roots[n:] - at, trees.feature[at:], trees.threshold[at:], trees.left[at:] - at, trees.right[at:] - at, trees.value[at:])


def _score_bins(trees: Trees) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(trees.predict(np.stack(x.to_numpy())) if len(x) else np.zeros(0), index=x.index)

    return run(F.col("x"))
