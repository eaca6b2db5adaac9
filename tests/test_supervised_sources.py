"""Sources that fail alone, restarts from a checkpoint, and metrics of micro-batches."""

import uuid

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quillrisk.plans import learned_queries as L
from quillrisk.session import shared_dir
from quillrisk.streaming import sources

SCHEMA = "seq long, url string"


def folder(spark, *files):
    path = f"{shared_dir(spark)}/in-{uuid.uuid4().hex}"
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def reader(spark, path):
    return lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_failing_source_does_not_stop_the_others(spark):
    good, late = folder(spark, [(1, "a"), (2, None)], [(3, "c")]), folder(spark, [(4, "d")])
    bad = folder(spark, [(5, "e")], [(6, "not a number")])

    def down():
        raise ConnectionError("HTTP 429")

    broken = lambda: reader(spark, bad)().withColumn("seq", F.when(F.col("seq") == 6, F.raise_error("bad row")).otherwise(F.col("seq")).cast("long"))
    schema = spark.createDataFrame([], SCHEMA).schema
    s = sources.Supervisor(spark, schema, {"good": reader(spark, good), "down": down, "broken": broken, "late": reader(spark, late)}, retries=1, counts={"no_url": "count_if(url IS NULL)"})
    s.run()
    assert {(r.source, r.seq) for r in s.rows().collect()} == {("good", 1), ("good", 2), ("good", 3), ("late", 4), ("broken", 5)}
    status = {r.source: r for r in s.status().collect()}
    assert (status["down"].errors, status["down"].dropped, status["down"].fetched) == (2, True, 0)
    assert (status["broken"].errors, status["broken"].dropped, status["broken"].fetched) == (2, True, 1)
    assert (status["good"].polls, status["good"].fetched, status["good"].errors, status["good"].dropped) == (2, 3, 0, False)
    batches = {(r.source, r.batch): r for r in s.progress().where("rows > 0").collect()}
    assert batches["good", 0].rows == 2 and batches["good", 0].observed == {"no_url": 1} and batches["good", 1].observed == {"no_url": 0}
    # a second run takes only what is new, and leaves the dropped sources out
    spark.createDataFrame([(7, "g")], SCHEMA).write.mode("append").parquet(late)
    s.run()
    assert s.rows().count() == 6 and {r.source: r.fetched for r in s.status().collect()}["late"] == 2


def test_a_source_that_mends_goes_on_from_its_checkpoint(spark):
    path, tries = folder(spark, [(1, "a")], [(2, "b")]), []

    def flaky():
        tries.append(1)
        rows = reader(spark, path)()
        return rows if len(tries) > 1 else rows.withColumn("seq", F.when(F.col("seq") == 2, F.raise_error("once")).otherwise(F.col("seq")).cast("long"))

    s = sources.Supervisor(spark, spark.createDataFrame([], SCHEMA).schema, {"flaky": flaky})
    s.run()
    assert sorted(r.seq for r in s.rows().collect()) == [1, 2] and len(tries) == 2
    row = s.status().first()
    assert (row.errors, row.dropped, row.fetched) == (1, False, 2)


def test_nothing_came(spark):
    s = sources.Supervisor(spark, spark.createDataFrame([], SCHEMA).schema, {"down": lambda: 1 / 0}, retries=0)
    s.run()
    assert s.rows().count() == 0 and s.progress().count() == 0 and s.status().first().dropped
    assert sources.latencies(s.progress()).count() == 0


def test_latencies(spark):
    rows = [("a", "r", i, 10, "t", ms, {}) for i, ms in enumerate([100, 200, 300, 400])] + [("a", "r", 9, 0, "t", 5000, {})]
    got = sources.latencies(spark.createDataFrame(rows, sources.PROGRESS)).first()
    assert (got.batches, got.rows, got.p50_ms, got.rows_per_second) == (4, 40, 250.0, pytest.approx(40.0))
    assert {r.source for r in L.h14_batch_latency(spark, SMALL).collect()} == {"source0", "source1", "source2"}
