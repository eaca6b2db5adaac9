"""Registered queries over file sources and sinks: the given tables go out as files of a kind and come back through its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillrisk.plans import models as M
from quillrisk.plans.queries import query
from quillrisk.session import shared_dir, table
from quillrisk.sources import files
from quillrisk.streaming import signals

DAY = 86_400_000_000


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/quillrisk/{name}-{uuid.uuid4().hex}"


_FIELDS = {1: "strftime(ts, '%Y%m%d%H%M%S')", 3: "'site' || (user_id % 20)", 4: "'https://x/' || event_id", 7: "upper(event_type)", 15: "CAST(event_id % 7 AS VARCHAR)"}


@query("SELECT " + ", ".join(f"{_FIELDS.get(k, repr(f'f{k}'))} AS {name}" for name, k in files.FEED_FIELDS.items()) + " FROM events")
def a1_scan_feed(spark, d):
    """Archives of the events as 27-column rows, and a row that is too short in each of them."""
    at, text = F.date_format("ts", "yyyyMMddHHmmss"), lambda c: F.col(c).cast("string")
    own = {1: at, 3: F.concat(F.lit("site"), (F.col("user_id") % 20).cast("string")), 4: F.concat(F.lit("https://x/"), text("event_id")), 7: F.upper("event_type"), 15: (F.col("event_id") % 7).cast("string")}
    line = F.concat_ws("\t", *[own.get(k, F.lit(f"f{k}")) for k in range(files.FEED_WIDTH)])
    rows = table(spark, d, "events").select(F.concat_ws("\n", line, F.when(F.col("event_id") % 50 == 0, "too\tshort")).alias("line"))
    return files.unzip_feed(files.zip_feed(rows, "line"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([c for c in [source, lang] if c <> ''])), ',') AS codes FROM documents")
def a3_country_codes(spark, d):
    from quillrisk.functions.text import location_codes

    part = lambda c: F.concat(F.lit("1#x#"), c, F.lit("#0"))
    places = F.concat_ws(";", part("source"), part("lang"), part("lang"), F.lit("1#short"), F.lit("1#x##0"))
    return M.documents(spark, d).select("doc_id", F.array_join(location_codes(places), ",").alias("codes"))


@query(f"WITH {M.SCORED} SELECT strftime(make_timestamp(t), '%Y-%m') AS month, seq, ticker, severity FROM scored")
def a6_append_monthly(spark, d):
    path, rows = _place(spark, "monthly"), M.scored(spark, d).select("seq", "ticker", "severity", "t")
    for half in (0, 1):
        files.append_monthly(rows.where(F.col("seq") % 2 == half), path, F.timestamp_micros("t"))
    return files.read_rows(spark, path, "seq long, ticker string, severity int").select("month", "seq", "ticker", "severity")


@query(f"WITH {M.SCORED} SELECT ticker, count(*) AS n, max(t) AS last FROM scored WHERE strftime(make_timestamp(t), '%Y-%m') = '2024-01' GROUP BY 1")
def a7_read_rows(spark, d):
    path = _place(spark, "monthly")
    files.append_monthly(M.scored(spark, d).select("seq", "ticker", "t"), path, F.timestamp_micros("t"))
    rows = files.read_rows(spark, path, "seq long, ticker string, t long").where("month = '2024-01'")
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), F.max("t").alias("last"))


@query(f"WITH {M.MENTIONS} SELECT t AS at, CASE ticker WHEN 'error' THEN 'fault' ELSE ticker END AS ticker, CAST(seq AS VARCHAR) AS text FROM mentions")
def a8_scan_posts(spark, d):
    path = _place(spark, "posts")
    at = F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd HH:mm:ss")
    M.mentions(spark, d).select(at.alias("at"), "ticker", F.col("seq").cast("string").alias("text")).write.option("header", True).csv(path)
    rows = files.scan_posts(spark, path, {"error": "fault"})
    return rows.select(F.unix_micros("at").alias("at"), "ticker", "text")


@query("SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus AS ticker, 'order ' || o_orderkey AS title FROM orders WHERE o_orderkey % 5 > 1")
def a9_scan_headlines(spark, d):
    path, five = _place(spark, "headlines"), F.col("o_orderkey") % 5
    day = F.when(five == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    title = F.when(five == 1, "  ").otherwise(F.concat(F.lit("order  "), F.col("o_orderkey").cast("string")))
    table(spark, d, "orders").select(day.alias("date"), F.col("o_orderstatus").alias("ticker"), title.alias("title")).write.option("header", True).csv(path)
    return files.scan_headlines(spark, path)


@query("SELECT url, CASE WHEN page_id % 2 = 0 THEN 'page ' || page_id ELSE 'page ' || page_id || ' more' END AS text FROM pages WHERE page_id % 3 > 0")
def a10_articles_to_documents(spark, d):
    seen = F.when(F.col("page_id") % 3 > 0, "20240102T030405Z").otherwise("yesterday")
    more = F.when(F.col("page_id") % 2 == 1, "more").otherwise("")
    one = F.struct(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), more.alias("description"), "url", seen.alias("seen"))
    lists = table(spark, d, "pages").select(F.to_json(F.array(one)).alias("payload"))
    return files.articles_to_documents(lists, "payload").select("url", "text")


@query("WITH " + M.PRICES + " SELECT session, CASE symbol " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.SYMBOLS.items()) + " END AS symbol, close FROM prices WHERE close IS NOT NULL")
def a11_prices_long(spark, d):
    wide = M.prices(spark, d).groupBy("session").pivot("symbol", list(M.SYMBOLS)).agg(F.first("close")).toDF("session", *M.SYMBOLS.values())
    return files.prices_long(wide, list(M.SYMBOLS.values()))


@query(f"""WITH {M.SCORED} SELECT seq, region || ',' || (region + 5) AS regions, '{{"outlet":' || outlet || ',"region":' || region || '}}' AS drivers,
  '{{"seq":' || seq || ',"ticker":"' || ticker || '","severity":' || severity || '}}' AS payload FROM scored""")
def a17_mentions_table(spark, d):
    drivers = F.create_map(F.lit("outlet"), "outlet", F.lit("region"), "region")
    return M.scored(spark, d).select(
        "seq", F.array_join(F.array("region", F.col("region") + 5), ",").alias("regions"), F.to_json(drivers).alias("drivers"), F.to_json(F.struct("seq", "ticker", "severity")).alias("payload")
    )


@query(f"WITH {M.SCORED} SELECT seq, ticker, severity FROM scored WHERE severity >= 3")
def a19_signals_jsonl(spark, d):
    path, schema = _place(spark, "signals"), "seq long, ticker string, severity int"
    before = files.read_signals(spark, path, schema)  # nothing yet
    rows = M.scored(spark, d).where("severity >= 3").select("seq", "ticker", "severity")
    files.append_signals(rows.where("severity = 3"), path)
    files.append_signals(rows.where("severity > 3"), path)
    return before.union(files.read_signals(spark, path, schema))


@query(f"WITH {M.SCORED} SELECT 'mentions' AS name, count(*) AS n FROM scored UNION ALL SELECT 'signals', count(*) FROM scored WHERE severity >= 3")
def a20_save_tables(spark, d):
    path, rows = _place(spark, "tables"), M.scored(spark, d)
    files.save_tables({"mentions": rows.limit(1)}, path)  # replaced below
    files.save_tables({"mentions": rows, "signals": rows.where("severity >= 3")}, path)
    count = lambda name: spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count("mentions").union(count("signals"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS merchant, round(o_totalprice, 2) AS amount FROM orders")
def a21_scan_transactions(spark, d):
    path = _place(spark, "transactions")
    rows = M.merchants(spark, d).withColumn("amount", F.concat(F.lit("$"), F.format_number("amount", 2)))
    rows.select("merchant", "month", "amount", "code").write.option("header", True).csv(path)
    return files.scan_transactions(spark, path, ["merchant", "amount"])


#: Made-up spreads in basis points and default rates in percent.
RATES = {"AAA": (45.0, 0.01), "AA": (60.0, 0.02), "A": (85.0, 0.05), "BBB": (140.0, 0.2), "BB": (260.0, 0.9), "B": (420.0, 3.5), "CCC": (950.0, 25.0)}
_RATE_ROWS = ", ".join(f"('{r}', {s}::DOUBLE, {p}::DOUBLE)" for r, (s, p) in RATES.items())


@query(f"WITH {M.POSITIONS}, rates(rating, bp, pct) AS (VALUES {_RATE_ROWS}) SELECT rating, any_value(bp) AS bp, count(*) AS n, sum(notional * pct / 100) AS expected_loss FROM positions JOIN rates USING (rating) GROUP BY 1")
def a22_rating_tables(spark, d):
    rates = spark.createDataFrame([(r, s, p) for r, (s, p) in RATES.items()], "rating string, bp double, pct double")
    held = M.positions(spark, d).join(F.broadcast(rates), "rating").groupBy("rating")  # seven rows
    return held.agg(F.first("bp").alias("bp"), F.count("*").alias("n"), F.sum(F.col("notional") * F.col("pct") / 100).alias("expected_loss"))


def _at(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = signals.read_table(spark, d, "events")
    return rows.select(F.col("event_id").cast("long").alias("seq"), us.alias("t"), F.timestamp_micros(us).alias("at"), (F.col("event_id") % 10 + 1).cast("int").alias("impact"))


_AT = "arrived AS (SELECT CAST(event_id AS BIGINT) AS seq, epoch_us(ts) AS t, CAST(event_id % 10 + 1 AS INTEGER) AS impact FROM events)"


@query(f"WITH {_AT} SELECT seq, t, impact FROM arrived ORDER BY t DESC, seq DESC LIMIT 500")
def i8_sink_daily(spark, d):
    path = _place(spark, "daily")
    sink = _at(spark, d).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint")
    sink.foreachBatch(lambda rows, batch: signals.append_daily(rows, batch, path, "at")).start().awaitTermination()
    return spark.read.schema("seq long, t long, impact int").json(path).select("seq", "t", "impact").orderBy(F.desc("t"), F.desc("seq")).limit(500)  # the latest, as a report


@query(f"WITH {_AT} SELECT seq, impact FROM arrived WHERE impact >= 8")
def i9_subscribe(spark, d):
    path = _place(spark, "published")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select(F.col("event_id").cast("long").alias("seq"), us.alias("t"), (F.col("event_id") % 10 + 1).cast("int").alias("impact"))
    files.append_signals(rows, path)
    return signals.run_to_table(signals.subscribe(spark, path, "seq long, t long, impact int", 8), "subscribed").select("seq", "impact")
