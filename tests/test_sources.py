"""File readers against small files with broken rows."""

import zipfile

from pyspark.sql import functions as F

from quillrisk.operators import features, market
from quillrisk.sources import files


def test_zipped_feed_keeps_whole_rows_only(spark, tmp_path):
    row = [f"f{k}" for k in range(files.FEED_WIDTH)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "\t".join(row) + "\n" + "\t".join(row[:20]) + '\n"quoted\t' + "\t".join(row[1:]) + "\n")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    rows = files.scan_zipped_feed(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and {r["url"] for r in rows} == {"f4"} and {r["extras"] for r in rows} == {"f26"}


def test_headlines_drop_unreadable_rows(spark, tmp_path):
    (tmp_path / "h.csv").write_text('date,ticker,title\n2020-01-02 10:00:00,A,"one,  two"\nsoon,A,x\n2020-01-03,,x\n2020-01-03,B,   \n')
    rows = files.scan_headlines(spark, str(tmp_path / "h.csv")).collect()
    assert [(str(r["day"]), r["ticker"], r["title"]) for r in rows] == [("2020-01-02", "A", "one, two")]


def test_money_and_missing_signals(spark, tmp_path):
    rows = spark.createDataFrame([("$1,234.50",), ("-$3",), ("x",), (None,)], "a string").select(files.money(F.col("a")).alias("m")).collect()
    assert [r["m"] for r in rows] == [1234.5, -3.0, None, None]
    assert files.read_signals(spark, str(tmp_path / "none"), "seq long").count() == 0


def test_articles_skip_bad_times_and_join_descriptions(spark):
    payload = '[{"title":"a","description":"b","url":"u","seen":"20240101T000000Z"},{"title":"c","seen":"20240101T000000Z"},{"title":"d","seen":"?"}]'
    lists = spark.createDataFrame([(payload,), (None,), ("[]",)], "payload string")
    assert sorted(r["text"] for r in files.articles_to_documents(lists, "payload").collect()) == ["a b", "c"]


def test_correlation_of_a_constant_is_null(spark):
    rows = spark.createDataFrame([("x", 1.0, 1.0), ("x", 1.0, 2.0), ("y", 1.0, 2.0), ("y", 2.0, 4.0)], "g string, a double, b double")
    got = {r["g"]: r["c"] for r in rows.groupBy("g").agg(market.correlation("a", "b").alias("c")).collect()}
    assert got["x"] is None and abs(got["y"] - 1) < 1e-12


def test_daily_sentiment_is_dense_and_empty_for_no_rows(spark):
    day = features.DAY
    rows = spark.createDataFrame([("a", 10, 0.5, 1.0), ("b", 2 * day + 5, -0.5, 1.0)], "k string, t long, s double, w double")
    got = {(r["k"], r["day"]): (r["net"], round(r["level"], 6)) for r in features.daily_sentiment(rows, "k", "t", "s", "w").collect()}
    assert got == {("a", 0): (1, 0.5), ("a", 1): (0, 0.5), ("a", 2): (0, 0.5), ("b", 0): (0, 0.0), ("b", 1): (0, 0.0), ("b", 2): (-1, -0.5)}
    assert features.daily_sentiment(rows.limit(0), "k", "t", "s", "w").count() == 0


def test_merge_labels_drops_the_market_only_beside_others(spark):
    found = spark.createDataFrame([(1, "MKT", 0.9), (2, "MKT", 0.8), (2, "A", 0.7)], "id int, ticker string, relevance double")
    given = spark.createDataFrame([(2, "A"), (2, "B")], "id int, ticker string")
    got = sorted(tuple(r) for r in features.merge_labels(found, given, "MKT").collect())
    assert got == [(1, "MKT", 0.9), (2, "A", 0.7), (2, "B", 0.3)]
