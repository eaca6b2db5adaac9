"""Running totals, ranks and quantiles of groups of any size: totals inside small buckets plus what the buckets before hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pieces of a group by its quantiles, and equal steps inside a piece.
PIECES, STEPS = 64, 64


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str | None, before: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` (None: the number) of the rows of the same ``keys`` that precede a row.

    The order is by ``bucket``, then by ``order`` inside one, so that buckets must rise with the order. Only bucket sums cross tasks; no window
    holds more rows than a bucket of a key.
    """
    amount = F.lit(1).cast("long") if value is None else F.col(value)
    sums = df.withColumn("_amount", amount).groupBy(*keys, bucket).agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(offsets, [*keys, bucket])
    return out.withColumn(before, F.col("_offset") + F.col("_inside")).drop("_offset", "_inside")


def with_bucket(rows: DataFrame, group: str, value: str, bucket: str = "_bucket") -> DataFrame:
    """Add ``bucket``, which rises with ``value`` in each group: pieces between approximate quantiles, cut in equal steps; nulls come first."""
    probabilities = F.array(*[F.lit(k / PIECES) for k in range(1, PIECES)])
    edges = rows.groupBy(group).agg(F.percentile_approx(value, probabilities, 1000).alias("_edges"))  # a row a group
    v = F.col(value)
    piece = F.size(F.filter(F.coalesce("_edges", F.array().cast(f"array<{rows.schema[value].dataType.simpleString()}>")), lambda e: e <= v))
    low, high = F.get("_edges", F.col("_piece") - 1), F.get("_edges", F.col("_piece"))
    step = F.when(high > low, F.least(F.lit(STEPS - 1), F.floor(STEPS * (v - low) / (high - low)))).otherwise(0)
    out = rows.join(edges, group).withColumn("_piece", piece)
    return out.withColumn(bucket, F.when(v.isNull(), -1).otherwise(F.col("_piece") * STEPS + F.coalesce(step, F.lit(0))).cast("long")).drop("_edges", "_piece")


def value_ranks(rows: DataFrame, group: str, value: str, times: str | None = None) -> DataFrame:
    """``(group, value, n, before)``: how often a value occurs and how many rows of the group have a smaller one.

    Equal values are one row before anything is ordered, so a value of a third of all rows is one entry. ``times``: how many rows a row stands for (None: itself).
    """
    values = rows.groupBy(group, value).agg((F.sum(times) if times else F.count("*")).alias("n"))
    return running_total(with_bucket(values, group, value), [group], "_bucket", [F.col(value)], "n", "before").drop("_bucket")


def average_ranks(rows: DataFrame, group: str, value: str, rank: str, times: str | None = None) -> DataFrame:
    """Add ``rank``: the place of the row's value in its group from 1, the mean of their places for equal values. ``times``: how many rows a row stands for."""
    ranks = value_ranks(rows, group, value, times).select(F.col(group).alias("_g"), F.col(value).alias("_v"), (F.col("before") + (F.col("n") + 1) / 2).alias(rank))
    return rows.join(ranks, F.col(group).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_g", "_v")


def places(rows: DataFrame, group: str, value: str, id_col: str, place: str) -> DataFrame:
    """Add ``place``: the row's place in its group by ``value``, from 0; equal values by ``id_col``."""
    return running_total(with_bucket(rows, group, value), [group], "_bucket", [F.col(value), F.col(id_col)], None, place).drop("_bucket")


def exact_quantiles(rows: DataFrame, group: str, value: str, quantiles: list[float], name: str = "quantiles") -> DataFrame:
    """``(group, name)``: an array of exact quantiles, linear between ranks, nulls left out."""
    ranks = value_ranks(rows.where(F.col(value).isNotNull()), group, value)
    sizes = ranks.groupBy(group).agg(F.sum("n").alias("_all"))  # a row a group
    at = [(k, end) for k in range(len(quantiles)) for end in ("low", "high")]
    place = lambda k, end: (F.floor if end == "low" else F.ceil)(F.lit(float(quantiles[k])) * (F.col("_all") - 1))
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(end).alias("end"), place(k, end).alias("at")) for k, end in at])
    hits = F.filter(wanted, lambda w: (w["at"] >= F.col("before")) & (w["at"] < F.col("before") + F.col("n")))
    found = ranks.join(sizes, group).select(group, "_all", value, F.explode(hits).alias("w")).groupBy(group)
    pick = lambda k, end: F.max(F.when((F.col("w.k") == k) & (F.col("w.end") == end), F.col(value)))
    found = found.agg(F.first("_all").alias("_all"), *[pick(k, end).alias(f"_{end}{k}") for k, end in at])
    between = lambda k, q: F.lit(float(q)) * (F.col("_all") - 1) - place(k, "low")
    out = [F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * between(k, q) for k, q in enumerate(quantiles)]
    return found.select(group, F.array(*out).alias(name))
