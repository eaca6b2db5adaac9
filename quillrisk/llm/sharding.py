"""Balanced label propagation: linked documents move to their neighbours' shards under quotas.

Documents of one link key (equal texts, unless another key is given) are neighbours. The copies of a key that start in one
shard move together as a *cell*; a key has at most as many cells as there are shards, so a row holds them all. Each
round, the cells of a key ask for its fullest shard. One count over all keys (a number a shard) says how much room every shard has
and how much is asked of it, and cells are let in by their hash, in that proportion. When the rounds
end, documents are ranked inside their shard, linked ones first; those beyond the shard's quota take
the free places of other shards, so that counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrisk.llm._ranks import running_total
from quillrisk.session import durable

_CELLS = "array<struct<start:int,n:bigint,label:int>>"


def _interval(bounds: list[int], rank: Column) -> Column:
    """Index of the first of the rising ``bounds`` (a number a shard) that is above ``rank``."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= rank))


def _wanted(shards: int) -> Column:
    """The shard that holds most rows of a key; ties go by hash."""
    total = lambda s: F.aggregate(F.filter("cells", lambda c: c["label"] == s), F.lit(0).cast("long"), lambda sum_, c: sum_ + c["n"])
    each = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(total(s).alias("n"), F.xxhash64("link", s).alias("tie"), s.alias("label")))
    return F.array_max(each)["label"]


def _round(links: DataFrame, shards: int, quota: int, turn: int) -> DataFrame:
    """One round over ``links (link, cells)``: cells ask for their key's fullest shard, and get it as far as there is room."""
    asked = links.withColumn("want", _wanted(shards))
    each = asked.select("want", F.inline("cells"))
    moves = F.col("label") != F.col("want")
    load = each.groupBy(F.col("want").alias("shard"), moves.alias("moves")).agg(F.sum("n").alias("n"))
    stay, ask = [0] * shards, [0] * shards
    for r in load.collect():  # two rows a shard; rows that stay are in the shard they want
        (ask if r["moves"] else stay)[r["shard"]] = r["n"]
    let_in = F.array(*[F.lit(min(1.0, max(0, quota - s) / a) if a else 1.0) for s, a in zip(stay, ask)])
    chance = lambda c: F.pmod(F.xxhash64("link", c["start"], F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
    label = lambda c: F.when(chance(c) < F.element_at(let_in, F.col("want") + 1), F.col("want")).otherwise(c["label"])
    cells = F.transform("cells", lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), label(c).alias("label")))
    return asked.select("link", cells.cast(_CELLS).alias("cells"))


def balanced_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, rounds: int = 3, link: Column | None = None
) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row; counts of shards differ by one at most.

    ``size`` is the text's UTF-8 bytes plus one. Null texts count as empty and null ids are kept. Rows
    with equal id and link are interchangeable. ``slot`` runs from 0 without gaps in every shard. ``cut``
    counts: see ``cut_links``. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    link = F.md5(text) if link is None else F.coalesce(F.md5(link.cast("string")), F.lit(""))
    facts = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        link.alias("link"),
    )
    facts = facts.withColumn("start", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    facts = durable(facts, "shard-facts")
    total = facts.count()
    quota = -(-total // shards)

    cells = facts.groupBy("link", "start").agg(F.count("*").alias("n"))
    links = cells.groupBy("link").agg(F.array_sort(F.collect_list(F.struct("start", "n", F.col("start").alias("label")))).alias("cells"), F.sum("n").alias("of"))
    links = durable(links.where("of > 1").select("link", F.col("cells").cast(_CELLS)), "links")  # a row a key, at most a cell a shard
    for turn in range(rounds):
        links = durable(_round(links, shards, quota, turn), "links")

    # Ranks inside a shard: linked rows by link, then the rest; the turn keeps any window short.
    of = F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + c["n"])
    spread = links.select("link", F.greatest(F.lit(1), F.ceil(of / 256)).alias("pieces"), F.inline("cells")).drop("n")
    placed = facts.join(spread, ["link", "start"], "left").withColumn("label", F.coalesce("label", "start"))
    piece = F.lpad(F.pmod(F.xxhash64("id", "size"), F.col("pieces")).cast("string"), 12, "0")
    turn = F.when(F.col("pieces").isNull(), F.concat(F.lit("1"), F.substring("link", 1, 3))).otherwise(
        F.concat(F.lit("0"), F.substring("link", 1, 3), F.when(F.col("pieces") > 1, piece).otherwise(""))
    )
    placed = placed.withColumn("turn", turn).withColumn("one", F.lit(1).cast("long")).drop("pieces", "start")
    placed = durable(running_total(placed, ["label"], "turn", [F.col("link"), F.col("id")], "one", "place"), "placed")

    held = {r["label"]: r["n"] for r in placed.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a shard
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    kept = [min(held.get(s, 0), quotas[s]) for s in range(shards)]
    free, spill = [], []
    for s in range(shards):
        free.append((free[-1] if free else 0) + quotas[s] - kept[s])
        spill.append((spill[-1] if spill else 0) + held.get(s, 0) - kept[s])
    pick = lambda values, index: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index + 1)
    over = F.col("place") >= pick(quotas, F.col("label"))
    # A row beyond its quota is the (rank)-th of all such rows, shard by shard, and takes the (rank)-th free place.
    rank = F.col("place") - pick(quotas, F.col("label")) + pick([0, *spill[:-1]], F.col("label"))
    target = _interval(free, rank).cast("int")
    moved = F.when(over, target).otherwise(F.col("label"))
    slot = F.when(over, pick(kept, target) + rank - pick([0, *free[:-1]], target)).otherwise(F.col("place"))
    return placed.select("id", "size", "text_crc32", "link", moved.alias("shard"), slot.cast("long").alias("slot"))


def cut_links(sharded: DataFrame) -> DataFrame:
    """``(linked, cut)``: rows that have copies, and those of them outside the fullest shard of their link."""
    cells = sharded.groupBy("link", "shard").agg(F.count("*").alias("n"))
    keys = cells.groupBy("link").agg(F.sum("n").alias("of"), F.max("n").alias("most")).where("of > 1")
    return keys.agg(F.coalesce(F.sum("of"), F.lit(0)).alias("linked"), F.coalesce(F.sum(F.col("of") - F.col("most")), F.lit(0)).alias("cut"))
