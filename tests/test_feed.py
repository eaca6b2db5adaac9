"""A feed of several sources: sorted files that follow each other, counts of the same pass."""

import glob

import pyarrow.parquet as pq

from quillrisk.operators import feed


def test_feed(spark, tmp_path):
    news = spark.createDataFrame([(1, 50, "Bank shares fall!", "A", "x"), (2, 40, "bank SHARES fall", "A", "y"), (3, 60, "Bank shares fall", "B", "z"), (4, 70, None, None, "u"), (5, 80, "", None, "v"), (6, 999, "late", "A", "w"), (7, None, "never", "A", "w")], "id long, t long, text string, ticker string, url string")
    social = spark.createDataFrame([(9, 45, "bank shares fall", "A"), (10, 45, "bank shares fall", "A")] + [(100 + i, i % 90, f"post {i}", "C") for i in range(200)], "id long, t long, text string, ticker string")
    nothing = news.limit(0)
    out = feed.build_feed({"news": news, "social": social, "nothing": nothing}, "id", "t", "text", "ticker", 0, 100, files=4, path=f"file://{tmp_path}/feed")
    rows = out.rows.collect()
    assert {(r.source, r.id) for r in rows if r.id < 100} == {("news", 2), ("news", 3), ("news", 4), ("social", 9)} and len(rows) == 204
    assert out.counts == {"news": {"fetched": 5, "kept": 3}, "social": {"fetched": 202, "kept": 201}, "nothing": {"fetched": 0, "kept": 0}}
    assert {r.source: r.duplicates for r in out.stats().collect()} == {"news": 2, "social": 1, "nothing": 0}
    assert all(r.url is None for r in rows if r.source == "social")
    times = [pq.read_table(f)["t"].to_pylist() for f in sorted(glob.glob(f"{tmp_path}/feed/part-*.parquet"))]
    assert len(times) > 1 and all(t == sorted(t) for t in times) and all(a[-1] <= b[0] for a, b in zip(times, times[1:]))


def test_empty_feed(spark):
    none = spark.createDataFrame([], "id long, t long, text string, ticker string")
    out = feed.build_feed({"a": none}, "id", "t", "text", "ticker", 0, 10)
    assert out.rows.count() == 0 and out.counts == {"a": {"fetched": 0, "kept": 0}}
