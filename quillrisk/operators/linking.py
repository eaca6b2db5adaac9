"""Event classes and lexicon sentiment over feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrisk.functions.text import phrase_count


def class_hits(text: Column, classes: dict[str, list[str]]) -> Column:
    """Array of ``(hits, order, class)`` in the order of priority."""
    return F.array(
        *[F.struct(phrase_count(text, words).alias("hits"), F.lit(-k).alias("order"), F.lit(c).alias("class")) for k, (c, words) in enumerate(classes.items())]
    )


def keyword_class(hits: Column, other: str = "OTHER") -> tuple[Column, Column]:
    """Class with most hits (the first by priority among equals) and its share of all hits."""
    best, total = F.array_max(hits), F.aggregate(hits, F.lit(0), lambda s, h: s + h["hits"])
    return F.when(total > 0, best["class"]).otherwise(other), F.when(total > 0, best["hits"] / total).otherwise(F.lit(0.0))


def single_class(hits: Column) -> Column:
    """The class, where exactly one has hits; else null."""
    some = F.filter(hits, lambda h: h["hits"] > 0)
    return F.when(F.size(some) == 1, F.get(some, F.lit(0))["class"])


def sample_per_group(rows: DataFrame, group: str, id_col: str, k: int, seed: str = "0") -> DataFrame:
    """``k`` rows of each group in the order of a hash: the same rows wherever they lie."""
    order = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":" + seed)))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order, id_col))).where(F.col("_n") <= k).drop("_n")


def entity_sentiment(clauses: DataFrame, mentions: DataFrame, doc_scores: DataFrame) -> DataFrame:
    """``(id, ticker, sentiment)``: mean clause score weighted by the entity's relevance, else the document's score.

    ``clauses``: ``id, clause, score``; ``mentions``: ``id, clause, ticker, relevance``; ``doc_scores``: ``id, score``.
    """
    weighted = mentions.join(clauses, ["id", "clause"]).groupBy("id", "ticker")
    means = weighted.agg((F.sum(F.col("score") * F.col("relevance")) / F.sum("relevance")).alias("own"))
    n = F.count("*").over(Window.partitionBy("id"))
    out = means.withColumn("n", n).join(doc_scores, "id")
    return out.select("id", "ticker", F.when(F.col("n") >= 2, F.coalesce("own", "score")).otherwise(F.col("score")).alias("sentiment"))


def reject(labels: Column, probabilities: Column, least: float = 0.5, other: str = "OTHER") -> tuple[Column, Column]:
    """The likeliest label, or ``other`` below ``least``, and its probability either way."""
    top = F.array_max(probabilities)
    best = F.element_at(labels, F.array_position(probabilities, top).cast("int"))
    return F.when(top >= least, best).otherwise(other), top
