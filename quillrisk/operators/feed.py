"""One feed out of several sources, in the order of time, with its counts."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillrisk.functions.text import dedupe_key
from quillrisk.operators.dedupe import keep_first
from quillrisk.session import shared_dir


@dataclass
class Feed:
    rows: DataFrame
    #: Rows of each source before and after deduplication, observed while the feed was written.
    counts: dict[str, dict[str, int]]

    def stats(self) -> DataFrame:
        """``(source, fetched, kept, duplicates)``."""
        rows = [(name, c["fetched"], c["kept"], c["fetched"] - c["kept"]) for name, c in self.counts.items()]
        return self.rows.sparkSession.createDataFrame(rows, "source string, fetched long, kept long, duplicates long")


def _counts(names: list[str]) -> list[Column]:
    return [F.count_if(F.col("source") == name).alias(f"n{k}") for k, name in enumerate(names)]


def build_feed(sources: dict[str, DataFrame], id_col: str, time: str, text: str, group: str, start: int, end: int, files: int = 8, path: str | None = None) -> Feed:
    """Rows of all sources with ``start <= time < end``, without repeats, as files that follow each other in time and are sorted inside.

    A repeat has the normal text and the group (null is a group) of an earlier row of its source; equal times go by id. Columns that a source lacks are
    null. Both counts are taken in the pass that writes; sources that give nothing count 0. Rows without a time are in no feed.
    """
    union = None
    for name, rows in sources.items():
        rows = rows.where((F.col(time) >= start) & (F.col(time) < end)).withColumn("source", F.lit(name))
        union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
    names, before, after = list(sources), Observation(), Observation()
    keyed = union.observe(before, *_counts(names)).withColumn("_key", dedupe_key(F.col(text))).withColumn("_group", F.coalesce(F.concat(F.lit("g"), F.col(group)), F.lit("none")))
    kept = keep_first(keyed, ["source", "_key", "_group"], [time, id_col]).select(*union.columns)
    out = path or f"{shared_dir(union.sparkSession)}/quillrisk/feed-{uuid.uuid4().hex}"
    # What is kept is counted behind the sort: the ranges come from a sample, which reads what lies before them once more.
    placed = kept.repartitionByRange(files, time).sortWithinPartitions(time, "source", id_col).observe(after, *_counts(names))
    placed.write.mode("overwrite").parquet(out)
    rows = union.sparkSession.read.schema(union.schema).parquet(out)
    none = rows.isEmpty() and union.isEmpty()  # a plan that is known to be empty observes nothing
    first, last = ({f"n{k}": 0 for k in range(len(names))},) * 2 if none else (before.get, after.get)
    return Feed(rows, {name: {"fetched": first[f"n{k}"], "kept": last[f"n{k}"]} for k, name in enumerate(names)})
