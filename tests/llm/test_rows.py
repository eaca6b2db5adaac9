"""Columns that have the operators' own names, equal ids with different texts, and rows that differ in other columns only."""

from collections import Counter

import corpus_pipeline
import pytest
from conftest import SMALL

from quillrisk.llm import decontam, mixing, sharding, simhash
from quillrisk.llm._rows import free_name, row_key
from quillrisk.session import table

OWN = ["_key", "_row", "_times", "_copy", "key", "row", "times", "copy", "digest", "id", "fp", "link"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word{i % 3} and some other words here {i}", "en", f"s{i % 2}", 9, *[f"{c}{i}" for c in OWN]) for i in range(12)]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *OWN])


def whole(df):
    return Counter(tuple(r) for r in df.collect())


def test_own_names_are_left_alone(spark, docs):
    known = whole(docs)
    for out in (simhash.keep_one(docs), decontam.keep_clean(docs, table(spark, SMALL, "benchmark")), mixing.mixed_documents(docs)):
        assert out.columns == docs.columns and out.count() and set(whole(out)) <= set(known)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert set(whole(stage(spark, docs, SMALL))) <= set(known), name
    assert sharding.balanced_shards(docs).count() == 12


def test_equal_ids_are_documents_of_their_own(spark):
    rows = [(1, "one two three four five six", "a"), (1, "an other text that shares no word with it", "b"), (1, "one two three four five six", "c"),
            (None, "seven eight nine ten eleven", "d"), (-5, "a third text about nothing in particular today", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = simhash.keep_one(docs).collect()
    assert Counter(r.text for r in kept) == Counter({t for _, t, _ in rows})
    assert {r.source for r in mixing.mixed_documents(docs, block_words=4, cycle=(1.0,)).collect()} == {"a", "b", "c", "d", "e"}


def test_names_and_keys(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "x", None), (1, None, "x")], "Key long, `a.b` string, key_ string")
    assert free_name(df, "key") == "key__"
    keys = [r[0] for r in df.select(row_key(df)).collect()]
    assert keys[0] == keys[2] != keys[1]


def test_rows_a_microsecond_apart_are_different(spark):
    docs = spark.sql("SELECT 1L AS doc_id, 'one two three' AS text, 'a' AS source, timestamp_micros(1700000000000000 + id) AS t, CAST(timestamp_micros(id) AS TIMESTAMP_NTZ) AS n FROM range(3)")
    assert len({r[0] for r in docs.select(row_key(docs)).collect()}) == len({r[0] for r in docs.select(row_key(docs, "t")).collect()}) == 3
    assert len({r[0] for r in docs.select(row_key(docs, "n")).collect()}) == 3
    assert whole(mixing.mixed_documents(docs, cycle=(1.0,))) == whole(docs)
