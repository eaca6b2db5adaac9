"""Registered queries that run as streams over what is there now."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrisk.plans import models as M
from quillrisk.plans.queries import query
from quillrisk.plans.risk_queries import cooldown_sql
from quillrisk.streaming import ordered, signals


def _stream(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    value = F.col("value")
    return signals.read_table(spark, d, "events").select(
        F.col("event_id").cast("long").alias("seq"), (us - us % M.QUARTER).alias("t"), F.col("event_type").alias("ticker"), ((value - 50) / (value + 50)).alias("sentiment"),
        F.timestamp_micros(us - us % M.QUARTER).alias("at"), (F.col("event_id") % 10 + 1).cast("int").alias("impact"),
    )


@query(f"""WITH {M.MENTIONS} SELECT (t // 3600000000 + 1) * 3600000000 AS as_of, ticker, count(*) AS mentions, avg(sentiment) AS sentiment FROM mentions
  WHERE (t // 3600000000 + 1) * 3600000000 <= (SELECT max(t) FROM mentions) GROUP BY 1, 2""")
def i7_emit_cadence(spark, d):
    return signals.run_to_table(signals.cadence(_stream(spark, d), "at", "ticker"), "cadence")


@query(f"WITH RECURSIVE {M.MENTIONS}, {cooldown_sql('SELECT ticker, t, seq, CAST(seq % 10 + 1 AS INTEGER) AS impact FROM mentions WHERE seq % 10 + 1 >= 8')} SELECT ticker, seq, decision FROM f")
def i6_stream_trigger(spark, d):
    """Signals that come up to 12 hours late, in files at random, with a restart after every lot."""
    rows = M.mentions(spark, d).select("ticker", "t", "seq", (F.col("seq") % 10 + 1).cast("int").alias("impact")).where("impact >= 8")
    return ordered.replay(rows, lambda s: ordered.triggers(s, "ticker", delay="13 hours"), "triggers")


@query(f"WITH {M.MENTIONS} SELECT DISTINCT story FROM mentions")
def i2_stream_dedupe(spark, d):
    """Stories as items: nine in ten have a URL."""
    rows = signals.read_table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("long").alias("story"))
    url = F.when(F.col("story") % 10 > 0, F.concat(F.lit("https://x/"), F.col("story").cast("string")))
    out = rows.select("at", "story", url.alias("url"), F.col("story").cast("string").alias("headline"))
    return signals.run_to_table(signals.drop_seen(out, "at", "url", "headline", "2 days"), "seen").select("story").distinct()
