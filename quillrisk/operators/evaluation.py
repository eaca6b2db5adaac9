"""Evaluation and data quality."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrisk.operators.market import correlation
from quillrisk.operators.totals import average_ranks, exact_quantiles, places


def classification_report(rows: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    """Per label: true and false positives, misses, precision, recall, F1 (0 where undefined); labels without rows too."""
    each = F.array(*[F.struct(F.lit(x).alias("label"), (F.col(gold) == x).alias("g"), (F.col(predicted) == x).alias("p")) for x in labels])
    out = rows.select(F.explode(each).alias("e")).groupBy(F.col("e.label").alias("label"))
    g, p = F.coalesce("e.g", F.lit(False)), F.coalesce("e.p", F.lit(False))
    out = out.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def confusion_matrix(rows: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    """``(gold, predicted, n)`` for every pair of ``labels``, 0 where no row has it; rows with other labels or nulls are in no cell."""
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("gold"), F.lit(p).alias("predicted")) for g in labels for p in labels])).alias("c")
    grid = rows.sparkSession.range(1).select(pairs).select("c.*")  # a row a cell
    counts = rows.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def overall(rows: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    """One row ``(n, accuracy, macro_f1)``: all rows, the share with equal labels (null never equals), the mean F1 of the fixed labels; 0 without rows."""
    report = classification_report(rows, gold, predicted, labels).agg(F.sum("f1").alias("_f1"))
    hits = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.coalesce(F.col(gold) == F.col(predicted), F.lit(False)).cast("double")), F.lit(0.0)).alias("accuracy"))
    return hits.crossJoin(report).select("n", "accuracy", (F.coalesce("_f1", F.lit(0.0)) / len(labels)).alias("macro_f1"))  # a row each


def tune_band(rows: DataFrame, gold: str, score: str, bands: list[float]) -> DataFrame:
    """``(band, macro_f1)`` for symmetric neutral bands, in one pass: the rows are exploded over the grid, not joined."""
    band = F.explode(F.array(*map(F.lit, bands))).alias("band")
    labels = ["negative", "neutral", "positive"]
    each = rows.select(F.col(gold).alias("g"), F.col(score).alias("s"), band)
    p = F.when(F.col("s") > F.col("band"), "positive").when(F.col("s") < -F.col("band"), "negative").otherwise("neutral")
    counts = each.withColumn("p", p).groupBy("band")
    sums = [F.count_if((F.col("g") == x) & (F.col("p") == x)).alias(f"t_{x}") for x in labels]
    sums += [(F.count_if(F.col("g") == x) + F.count_if(F.col("p") == x)).alias(f"n_{x}") for x in labels]
    f1 = [F.when(F.col(f"n_{x}") > 0, 2 * F.col(f"t_{x}") / F.col(f"n_{x}")).otherwise(F.lit(0.0)) for x in labels]
    return counts.agg(*sums).select("band", ((f1[0] + f1[1] + f1[2]) / 3).alias("macro_f1"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of Wilson's interval for a share of hits; null for no rows."""
    p = hits / n
    middle, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    base = 1 + z * z / n
    return (middle - width) / base, (middle + width) / base


def spearman(rows: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """``(group, spearman, n)``: correlation of average ranks; null where a column does not vary."""
    ranked = average_ranks(average_ranks(rows.select(group, a, b), group, a, "_a"), group, b, "_b")
    return ranked.groupBy(group).agg(correlation("_a", "_b").alias("spearman"), F.count("*").alias("n"))


def decile_means(rows: DataFrame, group: str, score: str, target: str, id_col: str) -> DataFrame:
    """Means of the target over ten bins of the score's ranks (first come first among equals)."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    placed = places(rows.select(group, score, target, id_col), group, score, id_col, "_place").join(sizes, group)
    bin_ = F.greatest(F.lit(0), F.ceil(F.col("_place") * 10 / F.greatest(F.col("_n") - 1, F.lit(1))) - 1)
    return placed.withColumn("decile", bin_.cast("int")).groupBy(group, "decile").agg(F.count("*").alias("n"), F.avg(target).alias("mean_target"))


def top_decile_hit(rows: DataFrame, group: str, score: str, target: str) -> DataFrame:
    """Share of the rows at or above the score's 90th percentile whose target is at or above its own."""
    scores, targets = (exact_quantiles(rows, group, c, [0.9], name) for c, name in ((score, "_s"), (target, "_t")))
    top = rows.join(scores, group).join(targets, group).where(F.col(score) >= F.col("_s")[0])
    return top.groupBy(group).agg(F.count("*").alias("n"), F.avg((F.col(target) >= F.col("_t")[0]).cast("double")).alias("hit_rate"))


def lagged_precision_recall(triggers: DataFrame, events: DataFrame, lag: int) -> DataFrame:
    """Triggers followed by an event within ``lag`` sessions, and events that a trigger came before; ``n``: session numbers."""
    spread = triggers.select("n", F.explode(F.sequence(F.col("n"), F.col("n") + lag)).alias("e")).join(events.select(F.col("n").alias("e")), "e")
    hits = spread.agg(F.count_distinct("n").alias("hit_triggers"), F.count_distinct("e").alias("hit_events"))
    totals = triggers.agg(F.count_distinct("n").alias("triggers")).crossJoin(events.agg(F.count_distinct("n").alias("events")))  # a row each
    out = hits.crossJoin(totals)
    return out.withColumns({"precision": F.col("hit_triggers") / F.col("triggers"), "recall": F.col("hit_events") / F.col("events")})


def poisson_cuts() -> np.ndarray:
    """Where a uniform number becomes a Poisson(1) count of 1, 2, ...; more than 8 has a chance of 1e-6."""
    return np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])


def bootstrap(rows: DataFrame, id_col: str, difference: str, draws: int = 1000) -> DataFrame:
    """Mean and 95 % interval of a paired difference: each row weighs Poisson(1) in each draw, from a hash of both.

    A task adds up all draws of its rows at once and sends one row of sums. Null differences are left out; without rows all is null.
    """
    cuts = poisson_cuts()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights = np.zeros(draws), np.zeros(draws)
        step = np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            h, d = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(h), 1024):
                w = _weights(h[at : at + 1024, None] + step, cuts)
                sums += d[at : at + 1024] @ w
                weights += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()]), pa.array([weights.tolist()])], ["sums", "weights"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights = np.zeros(draws), np.zeros(draws)
        for batch in batches:
            for k, total in enumerate((sums, weights)):
                total += batch.column(k).flatten().to_numpy().reshape(-1, draws).sum(axis=0)
        means = sums[weights > 0] / weights[weights > 0]
        out = [means.mean(), *np.quantile(means, [0.025, 0.975])] if len(means) else [None] * 3
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.float64()) for x in out], ["mean", "low", "high"])

    each = rows.select(F.xxhash64(id_col).alias("h"), F.col(difference).cast("double").alias("d")).where("d IS NOT NULL")
    parts = each.mapInArrow(add, "sums array<double>, weights array<double>")
    return parts.repartition(1).mapInArrow(finish, "mean double, low double, high double")  # a row a task


def _weights(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Counts from 64-bit numbers that are made even first."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(cuts, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53), side="right").astype(float)


def compare_tables(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: float) -> DataFrame:
    """``(column, only_a, only_b, differing, largest)`` of two versions of a table."""
    both = a.select(key, F.struct(*columns).alias("x")).join(b.select(key, F.struct(*columns).alias("y")), key, "full_outer")
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"x.{c}").cast("double").alias("p"), F.col(f"y.{c}").cast("double").alias("q")) for c in columns])
    rows = both.select(F.col("x").isNull().alias("no_x"), F.col("y").isNull().alias("no_y"), F.explode(each).alias("e"))
    gap = F.abs(F.col("e.p") - F.col("e.q"))
    return rows.groupBy(F.col("e.column").alias("column")).agg(
        F.count_if("no_y").alias("only_a"), F.count_if("no_x").alias("only_b"), F.count_if(gap > tolerance).alias("differing"), F.max(gap).alias("largest")
    )


def profile(rows: DataFrame) -> DataFrame:
    """``(column, kind, n, nulls, distinct, least, greatest)``: one pass over the table, distinct values by sketch."""
    named = [(c, t) for c, t in rows.dtypes if not t.startswith(("array", "map", "struct", "binary"))]
    sums = []
    for c, _ in named:
        sums += [F.count_if(F.col(c).isNull()).alias(f"{c}|nulls"), F.approx_count_distinct(c).alias(f"{c}|distinct")]
        sums += [F.min(c).cast("string").alias(f"{c}|least"), F.max(c).cast("string").alias(f"{c}|greatest")]
    wide = rows.agg(F.count("*").alias("n"), *sums)
    each = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("kind"), F.col("n"), *[F.col(f"`{c}|{k}`").alias(k) for k in ("nulls", "distinct", "least", "greatest")])
        for c, t in named
    ]
    return wide.select(F.explode(F.array(*each)).alias("p")).select("p.*")


def stratified_sample(rows: DataFrame, groups: list[str], id_col: str, quota: Column, seed: str = "0") -> DataFrame:
    """As many rows of each group as its quota, in the order of a hash."""
    order = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":" + seed)))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(order, id_col))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= quota).drop("_rank")
