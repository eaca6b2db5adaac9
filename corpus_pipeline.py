"""The corpus pipeline: toxic documents go, near-duplicates and benchmark passages go, sources are mixed, the mix is sharded.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``. Nulls, empty texts and repeated rows are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrisk.llm import decontam, langid, mixing, sharding, simhash, toxicity
from quillrisk.session import durable, table

TOXIC = 0.7
SHARDS = 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``. Null and empty texts score as an empty window; a label that is null or contradicts
    another is not learnt from; without labels of both classes nothing is dropped. Equal rows share their fate."""
    out = langid.held_out("doc_id", 3, 1)
    net = toxicity.fit(docs.where(~out), table(spark, sf_dir, "labels").where(~out), at=TOXIC)
    return toxicity.keep_clean(docs, net, at=TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest id, nulls last. Texts without words form one group; of rows that are equal in
    all columns one stays, and different texts under one id are different documents."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates. Null and empty texts are clean, null items are not tested, equal rows
    share their fate."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is a source of its own, documents without words stay, and
    rows that are equal in all columns share what is taken of them."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of every row, null ids and texts (size 1) and repeated rows too; counts of shards
    differ by one at most."""
    out = sharding.balanced_shards(docs, shards=SHARDS)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can express neither a trained network nor hash-ball links; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
