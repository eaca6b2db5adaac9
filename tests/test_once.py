"""Whole texts are brought into plain form once a row, however many phrases are looked for."""

from conftest import SMALL
from pyspark.sql import functions as F

from quillrisk.functions import text as X
from quillrisk.operators import entities
from quillrisk.plans import feature_queries, queries  # noqa: F401


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tags_read_one_text(spark):
    """A text that comes out anew each time it is worked out holds one of two words; looked at twice, it would hold both or none."""
    text = F.when(F.rand(3) < 0.5, "left").otherwise("right")
    rows = spark.range(400)
    tags = X.tags_of(text, [("L", [" left ", " none "]), ("R", [" right "])])
    assert {tuple(r.t) for r in rows.select(tags.alias("t")).collect()} == {("L",), ("R",)}
    assert all(r.t for r in rows.select(X.contains_any(text, [" left ", " right "]).alias("t")).collect())


def test_records_normalise_once(spark):
    for name in ("b10_filter_records", "b11_relink", "b12_feed_gates"):
        assert _plan(queries.QUERIES[name](spark, SMALL)).count("regexp_replace") == 1


def test_regions_normalise_once(spark):
    docs = spark.createDataFrame([(1, "The bank", "rates with care")], "id long, title string, text string")
    count = []
    for n in (1, 6):
        rules = entities.Rules(phrases=(("B", "strong", "bank"),), regions={f"R{k}": (" with ", " on ") if k else () for k in range(n + 1)})
        found = entities.link_entities(docs, "id", rules, F.col("title"), F.col("text"))
        assert found.first().regions == [f"R{k}" for k in range(1, n + 1)]
        count.append(_plan(found).count("regexp_replace"))
    assert count[0] == count[1]
