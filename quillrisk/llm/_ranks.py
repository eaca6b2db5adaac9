"""Running totals over orders too long for one task: totals inside small buckets plus bucket offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, before: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the same ``keys`` that precede a row.

    The order is by ``bucket``, then by ``order`` inside a bucket, so ``bucket`` must be a prefix of
    the order. Only bucket sums cross tasks; no window holds more rows than one bucket of one key.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        out.join(offsets, [*keys, bucket])
        .withColumn(before, F.col("_offset") + F.col("_inside"))
        .drop("_offset", "_inside")
    )
