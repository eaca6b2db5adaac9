"""Sources that run and fail alone, and what every micro-batch took.

A source is a query of its own with its own checkpoint. A supervisor starts them together, starts a failed one again from its checkpoint a few
times, and leaves it out after that; the others do not notice. A listener turns the progress of the queries into a table.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from quillrisk.session import shared_dir

PROGRESS = "source string, run string, batch long, rows long, started string, ms long, observed map<string,long>"
#: Progress rows that are held before they are written.
HELD = 1000


class Progress(StreamingQueryListener):
    """Rows of ``PROGRESS`` for the queries whose names begin with ``prefix``; what a query observes as whole numbers is in ``observed``."""

    def __init__(self, spark: SparkSession, path: str, prefix: str) -> None:
        self.spark, self.path, self.prefix = spark, path, prefix
        self.held: list[tuple] = []
        self.names: dict[str, str] = {}
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        if (event.name or "").startswith(self.prefix):
            self.names[str(event.runId)] = event.name[len(self.prefix) :]

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not (p.name or "").startswith(self.prefix):
            return
        observed = {k: v for row in p.observedMetrics.values() for k, v in row.asDict().items() if isinstance(v, int)}
        row = (p.name[len(self.prefix) :], str(p.runId), p.batchId, p.numInputRows, p.timestamp, int(p.durationMs.get("triggerExecution", 0)), observed)
        with self.lock:
            self.held.append(row)
            full = len(self.held) >= HELD
        if full:
            self.flush()

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        self.over(str(event.runId)).set()

    def over(self, run: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run, threading.Event())

    def flush(self) -> None:
        with self.lock:
            rows, self.held = self.held, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)


class Supervisor:
    """Streams by name, each a query of its own. ``make`` gives a source's stream; all streams have the columns of ``schema``.

    ``rows()``: what all sources gave, with ``source``; ``progress()``: a row for each micro-batch; ``status()``: a row for each source. ``counts`` are observed in the
    pass that writes the rows.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, sources: dict[str, Callable[[], DataFrame]], retries: int = 2, counts: dict[str, str] | None = None) -> None:
        self.spark, self.sources, self.retries, self.counts = spark, sources, retries, counts or {}
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        self.base = f"{shared_dir(spark)}/quillrisk/sources-{uuid.uuid4().hex}"
        self.errors: dict[str, list[str]] = {name: [] for name in sources}
        self.dropped: set[str] = set()

    def _start(self, name: str, prefix: str):
        rows = self.sources[name]().select(*self.schema.names)
        if self.counts:
            rows = rows.observe("counts", *[F.expr(e).cast("long").alias(c) for c, e in self.counts.items()])
        writer = rows.writeStream.queryName(prefix + name).format("parquet").option("path", f"{self.base}/rows/source={name}")
        return writer.option("checkpointLocation", f"{self.base}/checkpoints/{name}").trigger(availableNow=True).start()

    def run(self) -> None:
        """Take what is there now from all sources at once."""
        prefix = f"{uuid.uuid4().hex}:"
        listener = Progress(self.spark, f"{self.base}/progress", prefix)
        self.spark.streams.addListener(listener)
        try:
            waiting = {name: self.retries for name in self.sources if name not in self.dropped}
            while waiting:
                started = {}
                for name in waiting:
                    try:
                        started[name] = self._start(name, prefix)
                    except Exception as error:  # whatever a source's own code raises concerns that source alone
                        self.errors[name].append(str(error)[:500])
                for name, query in started.items():
                    try:
                        query.awaitTermination()
                        waiting.pop(name)
                    except PySparkException as error:
                        self.errors[name].append(str(error)[:500])
                    listener.over(str(query.runId)).wait(30)
                for name in list(waiting):
                    waiting[name] -= 1
                    if waiting[name] < 0:
                        self.dropped.add(name)
                        waiting.pop(name)
        finally:
            listener.flush()
            self.spark.streams.removeListener(listener)

    def _read(self, folder: str, schema: T.StructType | str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.base}/{folder}").parquet(f"{self.base}/{folder}")
        except PySparkException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # no source has come so far

    def rows(self) -> DataFrame:
        return self._read("rows", T.StructType([*self.schema.fields, T.StructField("source", T.StringType())]))

    def progress(self) -> DataFrame:
        return self._read("progress", PROGRESS)

    def status(self) -> DataFrame:
        """``(source, polls, fetched, errors, dropped, last_poll)``."""
        names = self.spark.createDataFrame([(n, len(e), n in self.dropped) for n, e in self.errors.items()], "source string, errors long, dropped boolean")
        taken = self.progress().where("rows > 0").groupBy("source").agg(F.count("*").alias("polls"), F.sum("rows").alias("fetched"), F.max("started").alias("last_poll"))
        return names.join(taken, "source", "left").select("source", F.coalesce("polls", F.lit(0)).alias("polls"), F.coalesce("fetched", F.lit(0)).alias("fetched"), "errors", "dropped", "last_poll")


def latencies(progress: DataFrame, key: str = "source", quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``(key, batches, rows, p50_ms, ..., rows_per_second)`` of micro-batches that had rows."""
    each = [F.percentile("ms", F.lit(q)).alias(f"p{round(q * 100)}_ms") for q in quantiles]
    out = progress.where("rows > 0").groupBy(key)
    return out.agg(F.count("*").alias("batches"), F.sum("rows").alias("rows"), *each, (F.sum("rows") * 1000 / F.greatest(F.sum("ms"), F.lit(1))).alias("rows_per_second"))
