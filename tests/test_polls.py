"""Polls of many rows with the same keys, and of many files."""

from conftest import SMALL
from pyspark.sql import functions as F

from quillrisk.plans import learned_queries as L
from quillrisk.streaming import polls


def test_equal_keys_enter_once(spark, monkeypatch):
    kind = "t long, seq long, url string, headline string"
    rows = [(k, k, f"u{k % 7}" if k % 3 else None, f"h{k % 5}" if k % 11 else " ") for k in range(300)]
    opened = []
    real = polls.durable
    monkeypatch.setattr(polls, "durable", lambda df, name: opened.append((name, real(df, name))) or opened[-1][1])
    got = {r.seq: r.kept for r in polls.drop_seen_two_key(spark.createDataFrame(rows, kind), "url", "headline", ["t", "seq"]).collect()}
    seen, want = set(), {}
    for _, seq, url, headline in rows:
        keys = {("text", headline)} | ({("url", url)} if url else set())
        want[seq] = bool(headline.strip()) and not keys & seen
        seen |= keys if want[seq] else set()
    assert got == want
    assert opened[0][0] == "open" and opened[0][1].count() == len({(u, h) for *_, u, h in rows if h.strip()}) < 100


def test_a_poll_is_a_batch_of_many_files(spark, monkeypatch):
    monkeypatch.setattr(L, "_items", lambda s, d, real=L._items: real(s, d).repartition(3, "seq"))
    out = L._polled(spark, SMALL)
    fetched = {r.poll: r.n for r in L._items(spark, SMALL).groupBy("poll").agg(F.count("*").alias("n")).collect()}
    assert {r.poll: r.fetched for r in out.metrics().collect()} == fetched
    log = spark.read.text(f"{out.base}/checkpoint/sources/0/*").where(F.contains("value", F.lit("inbox-")))
    assert log.count() > 4  # it was one file a poll, written by one task
