"""Structured Streaming counterparts of the feed and signal operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrisk.session import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 4) -> DataFrame:
    """A table's files as a stream, a few at a time."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parquet*")


def drop_seen(rows: DataFrame, time: str, url: str, headline: str, delay: str) -> DataFrame:
    """Drop rows whose URL or headline came before within ``delay``; rows without a URL are told apart by headline alone."""
    rows = rows.withWatermark(time, delay).withColumn("_url", F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit("none:"), headline)))
    return rows.dropDuplicatesWithinWatermark(["_url"]).dropDuplicatesWithinWatermark([headline]).drop("_url")


def cadence(rows: DataFrame, time: str, key: str, step: str = "60 minutes", delay: str = "0 seconds") -> DataFrame:
    """Counts and mean sentiment of each key for every step of stream time in which it was mentioned, once the step is over
    (``delay`` after its end in stream time); then its state goes."""
    out = rows.withWatermark(time, delay).groupBy(F.window(time, step).alias("w"), key).agg(F.count("*").alias("mentions"), F.avg("sentiment").alias("sentiment"))
    return out.select(F.unix_micros("w.end").alias("as_of"), key, "mentions", "sentiment")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run over what is there now, into a table of the shared folder, with a checkpoint beside it."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/quillrisk/stream-{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/rows").start()
    else:
        query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{base}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def append_daily(rows: DataFrame, batch: int, path: str, time: str) -> None:
    """A micro-batch as JSON, a folder a day, below a folder of the batch, which a batch that is repeated replaces."""
    rows.withColumn("day", F.date_format(time, "yyyy-MM-dd")).write.mode("overwrite").partitionBy("day").option("compression", "gzip").json(f"{path}/batch={batch}")


def subscribe(spark: SparkSession, path: str, schema: str, least_impact: int) -> DataFrame:
    """New signals of a folder of JSON files, from ``least_impact`` on; unfinished files are not listed."""
    return spark.readStream.schema(schema).json(path).where(F.col("impact") >= least_impact)
