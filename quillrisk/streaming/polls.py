"""Polls of several sources: what is new, what came too late, and the counts of every poll. A micro-batch is a poll."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrisk.session import durable, shared_dir

KINDS = ("kept", "late", "duplicate")


def drop_seen_two_key(rows: DataFrame, url: str, headline: str, order: list[str], seen: DataFrame | None = None) -> DataFrame:
    """Add ``kept`` to rows with a unique ``order``: false for an empty headline, and where a kept row before (or ``seen``: ``key``) has the URL or the headline.

    Only kept rows count as seen. Of rows with the same keys only the first can be kept, so it alone enters the rounds. Each round settles the rows that are first in both of their keys, and those that share a
    key with them; the rounds go on until every row is settled, in a table each. Null URLs share nothing.
    """
    place = F.struct(*order)
    keys = F.array_compact(F.array(F.when(F.coalesce(F.col(url), F.lit("")) != "", F.concat(F.lit("url:"), url)), F.concat(F.lit("text:"), headline)))
    blank = F.trim(F.coalesce(F.col(headline), F.lit(""))) == ""
    open_ = rows.where(~blank).select(place.alias("place"), keys.alias("keys")).groupBy("keys").agg(F.min("place").alias("place")).select("place", "keys")
    if seen is not None:
        known = open_.select("place", F.explode("keys").alias("key")).join(seen.select("key").distinct(), "key", "left_semi").select("place").distinct()
        open_ = open_.join(known, "place", "left_anti")
    spark, marks = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/quillrisk/kept-{uuid.uuid4().hex}"
    open_, kind = durable(open_, "open"), open_.select("place").schema
    open_.select("place").limit(0).write.parquet(marks)
    while open_.limit(1).count():
        each = open_.select("place", F.explode("keys").alias("key"))
        least = each.groupBy("key").agg(F.min("place").alias("first"))
        ranked = each.join(least, "key").groupBy("place").agg(F.bool_and(F.col("place") == F.col("first")).alias("wins"))
        won = durable(ranked.where("wins").select("place"), "won")
        won.write.mode("append").parquet(marks)
        taken = each.join(won, "place", "left_semi").select("key").distinct()
        lost = each.join(taken, "key", "left_semi").select("place").distinct()  # the winners among them
        open_ = durable(open_.join(lost, "place", "left_anti"), "open")
    kept = spark.read.schema(T.StructType([T.StructField("place", kind["place"].dataType)])).parquet(marks)
    out = rows.withColumn("_place", place).join(kept.select(F.col("place").alias("_place"), F.lit(True).alias("kept")), "_place", "left")
    return out.drop("_place").withColumn("kept", F.coalesce("kept", F.lit(False)))


class Polls:
    """State of a poller in tables of the shared folder, a folder a poll, so that a poll that is repeated replaces itself.

    ``rows``: all rows with ``kind`` (kept, late, duplicate); ``keys``: seen keys; ``polls``: counts and the latest time kept so far.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, source: str = "source", time: str = "t", url: str = "url", headline: str = "headline") -> None:
        self.spark, self.schema, self.source, self.time, self.url, self.headline = spark, schema, source, time, url, headline
        self.base = f"{shared_dir(spark)}/quillrisk/polls-{uuid.uuid4().hex}"

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")

    def poll(self, rows: DataFrame, number: int) -> None:
        """One poll: rows in order of time; too late is what is older than the latest row kept by the polls before, equal times are not."""
        earlier = F.col("poll") < number
        seen, latest = None, None
        if number:  # folders of the polls are partitions, so one read takes those before this one
            seen = self._read("keys", "key string, poll int").where(earlier).select("key")
            latest = self._read("polls", "latest long, poll int").where(earlier).agg(F.max("latest")).first()[0]
        marked = durable(drop_seen_two_key(rows, self.url, self.headline, [self.time, "seq"], seen), "poll")
        late = F.lit(False) if latest is None else F.col(self.time) < latest
        marked = marked.withColumn("kind", F.when(~F.col("kept"), "duplicate").when(late, "late").otherwise("kept")).drop("kept")
        counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
        newest = F.max(F.when(F.col("kind") == "kept", F.col(self.time))).alias("latest")
        seen_now = Observation()
        marked.observe(seen_now, F.count("*").alias("fetched"), *counts, newest).write.mode("overwrite").parquet(f"{self.base}/rows/poll={number}")
        keys = F.array_compact(F.array(F.when(F.coalesce(F.col(self.url), F.lit("")) != "", F.concat(F.lit("url:"), self.url)), F.concat(F.lit("text:"), self.headline)))
        marked.where("kind <> 'duplicate'").select(F.explode(keys).alias("key")).distinct().write.mode("overwrite").parquet(f"{self.base}/keys/poll={number}")
        got = seen_now.get  # counted while the rows were written
        newest_yet = max((x for x in (got["latest"], latest) if x is not None), default=None)
        row = (got["fetched"], *[got[k] for k in KINDS], newest_yet)
        self.spark.createDataFrame([row], "fetched long, kept long, late long, duplicate long, latest long").write.mode("overwrite").parquet(f"{self.base}/polls/poll={number}")

    def run(self, stream: DataFrame) -> None:
        """Take what is there now, a micro-batch a poll."""
        query = stream.writeStream.foreachBatch(self.poll).option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("kind", T.StringType()), T.StructField("poll", T.IntegerType())])).parquet(f"{self.base}/rows")

    def metrics(self) -> DataFrame:
        """``(poll, fetched, kept, late, duplicate)``."""
        return self._read("polls", "fetched long, kept long, late long, duplicate long, latest long, poll int").select("poll", "fetched", *KINDS)

    def fetched_by_source(self) -> DataFrame:
        return self.rows().groupBy("poll", self.source).agg(F.count("*").alias("fetched"))
