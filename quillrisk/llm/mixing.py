"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a list of slots, each worth ``block_words`` words. Slot ``i`` has the point
``frac((i + 1) * golden)``; the source whose stretch of the cumulative weights holds the point fills it.
Slots are ranked per source; the k-th slot of a source is joined with the k-th block of its words,
where its documents lie end to end in a shuffled (hash) order and start over when they run out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrisk.llm._ranks import running_total
from quillrisk.llm._rows import column, free_name, row_key
from quillrisk.session import durable

GOLDEN = 0.6180339887498949
CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words (runs other than space and 0x09-0x0D); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """``(source, source_size, weight)``: weights by turns in the order of the names, null last.

    ``sources`` has a row for each source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), turn + 1)
    return sources.withColumn("weight", weight)


def targets(weighted: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Add ``target``: shares of the total size by weight, none above ``max_epochs`` times its source.

    Sources are raised together until they reach their limits; those reached first (limit over weight)
    form a prefix, after which the rest share what is left.
    """
    order = Window.orderBy(F.col("_reach"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    out = weighted.withColumn("_limit", F.col("source_size") * F.lit(float(max_epochs)))
    out = out.withColumn("_reach", F.col("_limit") / F.col("weight"))
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_limit").over(order), F.lit(0.0))
    share = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    out = out.withColumn("_level", left / share)
    level = F.min(F.when(F.col("_reach") > F.col("_level"), F.struct("_reach", "_level"))).over(all_rows)["_level"]
    out = out.withColumn("target", F.least(F.col("_limit"), F.coalesce(level * F.col("weight"), F.col("_limit"))))
    return out.drop("_limit", "_reach", "_level")


def schedule(plan: DataFrame, block_words: int) -> DataFrame:
    """``(source, rank, slot)``: the slots of the mix, each source's ranked from 0 in the order of the mix.

    ``plan`` has ``source_key, need, lo, hi``: slots that a source needs and its stretch of the cumulative
    weights. Points of a low-discrepancy sequence miss ``need`` by a few slots; a source's slots beyond it are
    left out and those that it lacks are added after the rest, so that every source has ``need``.
    """
    spark = plan.sparkSession
    total = plan.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    slots = spark.range(total).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN)).alias("x"))
    slots = slots.select("slot", (F.col("x") - F.floor("x")).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS))
    cells = F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))
    stretch = plan.where("hi > lo").select("source_key", "need", "lo", "hi", F.explode(cells).alias("cell"))
    filled = slots.join(stretch, "cell").where("point >= lo AND point < hi").select("source_key", "need", "slot")
    # Turns of 4096 slots keep the ranking windows short.
    filled = filled.withColumn("turn", F.floor(F.col("slot") / 4096)).withColumn("one", F.lit(1).cast("long"))
    ranked = running_total(filled, ["source_key"], "turn", [F.col("slot")], "one", "rank").where("rank < need")
    have = filled.groupBy("source_key").agg(F.count("*").alias("have"))
    lacking = plan.join(have, "source_key", "left").select("source_key", "need", F.coalesce("have", F.lit(0)).alias("have"))
    tail = lacking.where("need > have").select("source_key", F.explode(F.sequence("have", F.col("need") - 1)).alias("rank"))
    tail = tail.withColumn("slot", F.lit(total) + F.col("rank"))
    return ranked.select("source_key", "rank", "slot").union(tail.select("source_key", "rank", "slot"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int = 1024,
    cycle: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: float = 3.0,
) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs``: ``(rows, pieces)``.

    ``rows`` has ``row, id, source, size, source_size, weight, target`` for each document. ``pieces`` has
    ``slot, rank, row, start, words``: the words of a document that a slot takes; a document that is
    taken more than once is in several slots. Null texts have no words; a null source is a source of
    its own; repeated rows are documents of their own; an empty table gives empty results. A source of a third of all
    rows is handled in parts: no step holds more than one hash turn of it.
    """
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col).cast("string")).alias("size"))
    rows = rows.withColumn("source_key", key).withColumn("shuffle", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = durable(rows, "mix-sizes")
    names = rows.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = targets(cycle_weights(names, cycle), max_epochs).withColumn("whole", F.floor("target"))

    # Slots needed: whole passes over the source, then blocks of the rest.
    blocks = F.ceil(F.col("source_size") / block_words)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("whole") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("blocks", blocks).withColumn("passes", passes)
    plan = plan.withColumn("rest", F.col("whole") - F.col("passes") * F.col("source_size"))
    plan = plan.withColumn("need", (F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block_words)).cast("long"))
    upto = Window.orderBy(F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, 0)
    plan = plan.withColumn("hi", F.sum("need").over(upto) / F.greatest(F.sum("need").over(Window.partitionBy()), F.lit(1)))
    before = F.coalesce(F.lag("hi").over(Window.orderBy(F.col("source").isNull(), F.col("source"))), F.lit(0.0))
    plan = durable(plan.withColumn("lo", before), "mix-plan")

    placed = rows.withColumn("turn", F.substring("shuffle", 1, 3))
    order = [F.col("shuffle"), F.col("id"), F.col("size")]
    placed = running_total(placed, ["source_key"], "turn", order, "size", "begin")
    inside = Window.partitionBy("source_key", "turn").orderBy(*order)
    placed = placed.withColumn("row", F.concat("source_key", F.lit(":"), "turn", F.lit(":"), F.row_number().over(inside).cast("string")))
    placed = durable(placed.join(plan.select("source_key", "source_size", "weight", "target"), "source_key").drop("turn", "shuffle"), "mix-placed")

    end = F.col("begin") + F.col("size")
    span = F.sequence(F.floor(F.col("begin") / block_words), F.floor((end - 1) / block_words))
    parts = placed.where("size > 0").select("source_key", "row", "begin", end.alias("end"), F.explode(span).alias("block"))
    first, last = F.col("block") * block_words, (F.col("block") + 1) * block_words
    parts = parts.select("source_key", "row", "block", F.greatest("begin", first).alias("lo"), F.least("end", last).alias("hi"), "begin")

    slots = schedule(plan.select("source_key", "need", "lo", "hi"), block_words).join(
        plan.select("source_key", "blocks", "passes", "rest"), "source_key"
    )
    slots = slots.withColumn("block", F.col("rank") % F.col("blocks"))
    limit = F.when(F.floor(F.col("rank") / F.col("blocks")) < F.col("passes"), F.lit(2**62)).otherwise(F.col("rest"))
    slots = slots.select("source_key", "block", "rank", "slot", limit.alias("limit"))
    pieces = slots.join(parts, ["source_key", "block"]).withColumn("hi", F.least("hi", "limit")).where("hi > lo")
    pieces = pieces.select("slot", "rank", "row", (F.col("lo") - F.col("begin")).alias("start"), (F.col("hi") - F.col("lo")).alias("words"))
    return placed.select("row", "id", "source", "size", "source_size", "weight", "target"), pieces


def taken_words(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """``rows`` with ``taken``: the words that the mix takes of each document, repeats counted."""
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, with all their columns: each as often as its words are taken, to the nearest whole number.

    Documents without words stay as they are. Rows are told apart by all their columns; rows that are equal in everything
    share what is taken of them. No column of ``docs`` is touched, whatever its name.
    """
    key, times = free_name(docs, "key"), free_name(docs, "times")
    keyed = docs.withColumn(key, row_key(docs))
    named = keyed.select(F.col(key).alias("key"), column(text_col).alias("text"), column(source_col).alias("source"))
    rows, pieces = mix(named, "key", "text", "source", **options)
    often = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5)).cast("int")
    taken = taken_words(rows, pieces).groupBy(F.col("id").alias(key)).agg(F.sum(often).cast("int").alias(times))
    out = keyed.dropDuplicates([key]).join(taken, key).where(F.col(times) > 0)
    copies = F.explode(F.sequence(F.lit(1), F.col(times)))
    return out.select(*map(column, docs.columns), copies.alias(free_name(docs, "copy"))).select(*map(column, docs.columns))
