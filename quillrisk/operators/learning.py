"""Text vectors, a calibrated event classifier and grouped cross-validation, with Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrisk.operators.evaluation import classification_report
from quillrisk.session import durable

#: Fits that run side by side, and rows a task of a fit has at least: a fit is some hundred short jobs, whose starting and gathering take longer than their work on few rows.
AT_ONCE, TASK_ROWS = 6, 50_000


def embed(rows: DataFrame, id_col: str, tokens: str, dims: int = 4096, least_docs: int = 2) -> DataFrame:
    """``(id, features)``: hashed TF-IDF vectors of length one; rows without tokens have the zero vector.

    The counts are written once, so that tokens are not worked out again for the weights.
    """
    named = rows.select(F.col(id_col).alias("id"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
    counted = durable(HashingTF(numFeatures=dims, inputCol="tokens", outputCol="counts").transform(named).select("id", "counts"), "counts")
    weighted = IDF(minDocFreq=least_docs, inputCol="counts", outputCol="weighted").fit(counted).transform(counted)
    return Normalizer(p=2.0, inputCol="weighted", outputCol="features").transform(weighted).select("id", "features")


def fold_of(group: str, folds: int, seed: int = 0) -> Column:
    """Fold of a row by its group, which is never split."""
    return F.pmod(F.crc32(F.concat(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit(f":{seed}"))), F.lit(folds)).cast("int")


def balanced(rows: DataFrame, label: str, gold: str | None = None, gold_weight: float = 10.0) -> DataFrame:
    """Add ``weight``: n / (classes * rows of the class), times ``gold_weight`` for gold rows."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    counts = counts.withColumns({"_all": F.sum("_n").over(Window.partitionBy()), "_k": F.count("*").over(Window.partitionBy())})  # a row a class
    weight = F.col("_all") / (F.col("_k") * F.col("_n")) * (F.when(F.col(gold), gold_weight).otherwise(1.0) if gold else F.lit(1.0))
    return rows.join(counts, label).withColumn("weight", weight).drop("_n", "_all", "_k")


@dataclass
class Classifier:
    """A multinomial model with an isotonic curve a class; ``curves`` hold its steps, ``labels`` the classes by index."""

    labels: list[str]
    model: LogisticRegressionModel
    curves: list[tuple[list[float], list[float]]]

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``features``) with ``predicted`` and ``confidence``, calibrated and renormalised."""
        scored = self.model.transform(rows).withColumn("_p", vector_to_array("probability"))
        level = [_curve(F.col("_p")[k], *curve) for k, curve in enumerate(self.curves)]
        scored = scored.withColumn("_c", F.array(*level)).withColumn("_sum", F.aggregate("_c", F.lit(0.0), lambda s, x: s + x))
        share = F.when(F.col("_sum") > 0, F.transform("_c", lambda x: x / F.col("_sum"))).otherwise(F.col("_p"))
        best = F.array_max(F.transform(share, lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
        names = F.array(*map(F.lit, self.labels))
        return scored.select(*rows.columns, F.element_at(names, 1 - best["i"]).alias("predicted"), best["p"].alias("confidence"))


def _curve(x: Column, bounds: list[float], values: list[float]) -> Column:
    """The isotonic curve through its points, straight between them and flat outside."""
    out = F.when(x <= bounds[0], values[0])
    for a, b, u, v in zip(bounds, bounds[1:], values, values[1:]):
        out = out.when(x <= b, F.lit(v) if b <= a else u + (v - u) * (x - a) / (b - a))
    return out.otherwise(values[-1])


def _logistic(c: float, rows: int) -> LogisticRegression:
    """Inverse strength ``c`` as a penalty on the mean loss."""
    return LogisticRegression(featuresCol="features", labelCol="index", weightCol="weight", regParam=1.0 / (c * max(1, rows)), family="multinomial", maxIter=60)


def _fitted(rows: DataFrame, jobs: list[tuple[Column | None, float]]) -> list[LogisticRegressionModel]:
    """A model for each ``(which rows to train on, c)``, in their order; the jobs of ``AT_ONCE`` of them share the cores."""
    n = rows.count()
    fewer = rows.coalesce(max(1, n // TASK_ROWS))  # never more tasks than the rows have

    def one(job: tuple[Column | None, float]) -> LogisticRegressionModel:
        which, c = job
        return _logistic(c, n).fit(fewer if which is None else fewer.where(which))

    run: Callable = inheritable_thread_target(rows.sparkSession)(one)
    with ThreadPool(min(AT_ONCE, len(jobs))) as pool:
        return pool.map(run, jobs, chunksize=1)


def _indexed(rows: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    labels = [r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]  # a row a class
    index = F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1
    return rows.where(F.col(label).isNotNull()).withColumn("index", index.cast("double")), labels


def train_classifier(rows: DataFrame, label: str, group: str, gold: str | None = None, c: float = 4.0, folds: int = 3, points: int = 50) -> Classifier:
    """A class-balanced multinomial regression, calibrated on scores of folds that it has not seen.

    ``rows``: ``features``, a label (nulls are left out), a group that no fold splits, and whether a row is gold. Each class's curve is an isotonic
    regression of hits on out-of-fold scores, kept as at most ``points`` steps.
    """
    known, labels = _indexed(rows, label)
    known = durable(balanced(known, label, gold).withColumn("fold", fold_of(group, folds)), "training")
    *models, whole = _fitted(known, [*[(F.col("fold") != k, c) for k in range(folds)], (None, c)])
    parts = [m.transform(known.where(F.col("fold") == k)).select("index", "weight", vector_to_array("probability").alias("p")) for k, m in enumerate(models)]
    unseen = parts[0]
    for part in parts[1:]:
        unseen = unseen.union(part)
    unseen, curves = durable(unseen, "unseen"), []
    for k in range(len(labels)):
        hits = unseen.select(F.col("p")[k].alias("features"), (F.col("index") == k).cast("double").alias("label"), "weight")
        curve = IsotonicRegression(featuresCol="features", labelCol="label", weightCol="weight").fit(hits)
        x, y = curve.boundaries.toArray().tolist(), curve.predictions.toArray().tolist()
        keep = sorted({0, len(x) - 1, *range(0, len(x), max(1, len(x) // points))})
        curves.append(([x[i] for i in keep], [y[i] for i in keep]))
    return Classifier(labels, whole, curves)


def cross_validate(rows: DataFrame, label: str, group: str, candidates: dict[str, float], seeds: int = 2, folds: int = 3) -> DataFrame:
    """``(candidate, seed, fold, macro_f1)``: each candidate's strength on folds by group, which never part a group.

    Each fit is Spark jobs over all rows of its folds, and some fits run side by side.
    """
    known, labels = _indexed(rows, label)
    known = durable(balanced(known, label), "cross-validation")
    fits = [(seed, k, name) for seed in range(seeds) for k in range(folds) for name in candidates]
    models = _fitted(known, [(fold_of(group, folds, seed) != k, candidates[name]) for seed, k, name in fits])
    out = None
    for (seed, k, name), model in zip(fits, models):
        test = known.where(fold_of(group, folds, seed) == k)
        found = model.transform(test).select(F.col("index").cast("int").cast("string").alias("g"), F.col("prediction").cast("int").cast("string").alias("p"))
        report = classification_report(found, "g", "p", [str(i) for i in range(len(labels))])
        one = report.agg(F.avg("f1").alias("macro_f1")).select(F.lit(name).alias("candidate"), F.lit(seed).alias("seed"), F.lit(k).alias("fold"), "macro_f1")
        out = one if out is None else out.union(one)
    return durable(out, "cross-validated")


def as_vector(column: str) -> Column:
    return array_to_vector(F.col(column).cast("array<double>"))
