"""Time-ordered impact drivers, severity bins and signals.

Rows have a key, a time ``t`` in microseconds and ``seq``, the place in the feed that settles ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrisk.operators.nearest import greatest_earlier

from quillrisk.operators.totals import exact_quantiles, running_total

HOUR = 3_600_000_000


def with_history(rows: DataFrame, t: str, history: int) -> DataFrame:
    """Rows in time blocks as long as ``history``, each also in the next block, marked ``past`` there.

    Windows over (key, block) then see all they look back to, and no key's whole life meets in a task.
    """
    block = F.floor(F.col(t) / history)
    both = F.array(F.struct(block.alias("block"), F.lit(False).alias("past")), F.struct((block + 1).alias("block"), F.lit(True).alias("past")))
    return rows.withColumn("_b", F.explode(both)).select("*", F.col("_b.block").alias("block"), F.col("_b.past").alias("past")).drop("_b")


def velocity(rows: DataFrame, key: str, window: int = 6 * HOUR, buckets: int = 28, min_std: float = 1.0) -> DataFrame:
    """Add ``recent``, ``z`` and ``velocity``: mentions in ``(t - window, t]`` so far, against the buckets before.

    Buckets are relative to each row: half-open, the last closed. All counts share one partitioning and sort.
    """
    history = window * (buckets + 1)
    blocks = with_history(rows, "t", history)
    over = Window.partitionBy(key, "block").orderBy("t")
    upto = lambda back: F.count("*").over(over.rangeBetween(Window.unboundedPreceding, -back))
    place = F.row_number().over(Window.partitionBy(key, "block").orderBy("t", "seq"))
    before = [upto(window * (buckets + 1 - i) + 1) for i in range(buckets)]
    columns = {"_place": place, "_last": upto(window)} | {f"_c{i}": c for i, c in enumerate(before)}
    out = blocks.withColumns(columns).where("NOT past")
    ends = [*(F.col(f"_c{i}") for i in range(1, buckets)), F.col("_last")]
    counts = [end - F.col(f"_c{i}") for i, end in enumerate(ends)]
    mean = sum(counts[1:], counts[0]) / buckets
    square = sum((c * c for c in counts[1:]), counts[0] * counts[0]) / buckets
    out = out.withColumn("recent", F.col("_place") - F.col("_last")).withColumn("_mean", mean).withColumn("_square", square)
    std = F.sqrt(F.greatest(F.col("_square") - F.col("_mean") * F.col("_mean"), F.lit(0.0)))
    out = out.withColumn("z", (F.col("recent") - F.col("_mean")) / F.greatest(std, F.lit(min_std)))
    return out.withColumn("velocity", 1 / (1 + F.exp(-F.col("z")))).select(*rows.columns, "recent", "z", "velocity")


def breadth(rows: DataFrame, key: str, outlet: str, window: int = 6 * HOUR, saturation: int = 20) -> DataFrame:
    """Add ``outlets`` and ``breadth``: distinct outlets in the closed ``[t - window, t]``, later rows of the same time included.

    An outlet counts from a mention that is more than ``window`` after its last one, until ``window`` after its last before such a pause; the number at a time is the
    sum of those steps so far, in one pass over a block of a key.
    """
    blocks = with_history(rows, "t", window)
    own = Window.partitionBy(key, "block", outlet).orderBy("t")
    marked = blocks.withColumns({"_prev": F.lag("t").over(own), "_next": F.lead("t").over(own)})
    enters = F.when(F.col("_prev").isNull() | (F.col("t") - F.col("_prev") > window), F.struct(F.col("t").alias("at"), F.lit(1).alias("step")))
    leaves = F.when(F.col("_next").isNull() | (F.col("_next") - F.col("t") > window), F.struct((F.col("t") + window + 1).alias("at"), F.lit(-1).alias("step")))
    steps = marked.select(key, "block", F.explode(F.array_compact(F.array(enters, leaves))).alias("s")).groupBy(key, "block", F.col("s.at").alias("t")).agg(F.sum("s.step").alias("_step"))
    both = blocks.withColumn("_step", F.lit(0).cast("long")).unionByName(steps.withColumn("past", F.lit(True)), allowMissingColumns=True)
    over = Window.partitionBy(key, "block").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("outlets", F.sum("_step").over(over).cast("int")).where("NOT past")
    share = F.log1p(F.col("outlets").cast("double")) / F.log1p(F.lit(float(saturation)))
    return out.withColumn("breadth", F.least(F.lit(1.0), share)).select(*rows.columns, "outlets", "breadth")


def novelty(rows: DataFrame, block: str, vector: str, lookback: int) -> DataFrame:
    """``(seq, novelty)``: one minus the greatest cosine to unit vectors of the same block in the last ``lookback``, 1 if none; a null vector has 1."""
    near = greatest_earlier(rows, block, vector, lookback).select("seq", "near")
    return rows.select("seq").join(near, "seq", "left").select("seq", F.greatest(F.lit(0.0), 1 - F.coalesce("near", F.lit(0.0))).alias("novelty"))


#: Weights of the drivers and the floor of the relevance factor; fixed values of the score.
DRIVER_WEIGHTS = {"sentiment_strength": 0.35, "velocity": 0.25, "breadth": 0.15, "novelty": 0.15, "credibility": 0.10}
RELEVANCE_FLOOR = 0.5


def raw_impact(prior: Column, drivers: dict[str, Column], relevance: Column) -> Column:
    """The prior of the class times the weighted drivers times the relevance factor; a null driver gives null."""
    mixed = sum((drivers[k] * w for k, w in list(DRIVER_WEIGHTS.items())[1:]), drivers["sentiment_strength"] * DRIVER_WEIGHTS["sentiment_strength"])
    return prior * mixed * (RELEVANCE_FLOOR + (1 - RELEVANCE_FLOOR) * relevance)


def contributions(prior: Column, drivers: dict[str, Column], relevance: Column) -> Column:
    """Each driver's part of the raw impact, as a map."""
    factor = prior * (RELEVANCE_FLOOR + (1 - RELEVANCE_FLOOR) * relevance)
    return F.create_map(*[x for k, w in DRIVER_WEIGHTS.items() for x in (F.lit(k), factor * drivers[k] * w)])


def fit_bins(burn_in: DataFrame, group: str, value: str, quantiles: list[float]) -> DataFrame:
    """``(group, edges)``: exact quantiles, linear between ranks."""
    return exact_quantiles(burn_in, group, value, quantiles, "edges")


def apply_bins(rows: DataFrame, edges: DataFrame, group: str, value: str) -> DataFrame:
    """Add ``severity``: one plus the edges at or below the value; groups without edges use ten equal steps."""
    step = F.least(F.lit(10), F.greatest(F.lit(1), F.ceil(F.col(value) * 10))).cast("int")
    own = (F.size(F.filter("edges", lambda e: e <= F.col(value))) + 1).cast("int")
    return rows.join(edges, group, "left").withColumn("severity", F.when(F.col("edges").isNull(), step).otherwise(own)).drop("edges")


def market_session(ts: Column, sessions: DataFrame, rows: DataFrame, close_hour: int = 16, close_inclusive: bool = False, clip: bool = True) -> DataFrame:
    """Add ``session``: the first session on or after the row's New York day, the next day from the close on.

    Past the last session: that one if ``clip``, else null. ``close_inclusive``: a row at the very close is still that day's.
    """
    local = F.from_utc_timestamp(ts, "America/New_York")
    at_close = F.make_timestamp(F.year(local), F.month(local), F.dayofmonth(local), F.lit(close_hour), F.lit(0), F.lit(0))
    late = local > at_close if close_inclusive else local >= at_close
    day = F.date_add(F.to_date(local), F.when(late, 1).otherwise(0))
    nxt = Window.orderBy("session")  # one row a session of the calendar
    spans = sessions.select("session", F.coalesce(F.lag("session").over(nxt), F.date_sub("session", 3660)).alias("before"))
    days = spans.select("session", F.explode(F.sequence(F.date_add("before", 1), F.col("session"))).alias("day"))
    out = rows.withColumn("day", day).join(days, "day", "left").drop("day")
    if clip:
        last = sessions.agg(F.max("session")).first()[0]
        out = out.withColumn("session", F.coalesce("session", F.when(ts.isNotNull(), F.lit(last))))
    return out


def session_running_max(rows: DataFrame, key: str, drivers: list[str]) -> DataFrame:
    """Add the running maximum of each driver and ``log1p`` of the count, per key and session up to the row."""
    over = Window.partitionBy(key, "session").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"max_{d}": F.max(d).over(over) for d in drivers} | {"log_count": F.log1p(F.count("*").over(over).cast("double"))})


def ewma(rows: DataFrame, key: str, value: str, weight: Column, half_life: int) -> DataFrame:
    """Add ``num, den, level, confidence``: sums that halve every ``half_life``, per key up to each row.

    Weights are scaled up from the start of blocks of 64 half-lives, so nothing overflows and no key is one task;
    a block starts from the total of the one before, and older ones are below a double's precision beside the row itself.
    """
    span = 64 * half_life
    scaled = rows.withColumn("_block", F.floor(F.col("t") / span)).withColumn("_w", weight)
    grow = F.pow(F.lit(2.0), (F.col("t") - F.col("_block") * span) / F.lit(float(half_life)))
    scaled = scaled.withColumn("_grow", grow)
    num, den = F.sum(F.col("_w") * F.col(value) * F.col("_grow")), F.sum(F.col("_w") * F.col("_grow"))
    totals = scaled.groupBy(key, (F.col("_block") + 1).alias("_block")).agg((num * 2.0**-64).alias("_num"), (den * 2.0**-64).alias("_den"))
    over = Window.partitionBy(key, "_block").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    out = scaled.withColumns({"num": num.over(over), "den": den.over(over)}).join(totals, [key, "_block"], "left")
    out = out.withColumn("num", (F.col("num") + F.coalesce("_num", F.lit(0.0))) / F.col("_grow"))
    out = out.withColumn("den", (F.col("den") + F.coalesce("_den", F.lit(0.0))) / F.col("_grow"))
    level = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("num") / F.col("den")))
    return out.withColumn("level", level).withColumn("confidence", 1 - F.exp(-F.col("den") / 3)).select(
        *rows.columns, "num", "den", "level", "confidence"
    )


def top_evidence(rows: DataFrame, group: list[str], strength: str, fields: list[str], k: int = 5) -> DataFrame:
    """``(group, evidence)``: the ``k`` strongest rows in order, earlier ones first among equals."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(strength), "seq"))
    best = rows.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return best.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_rank", *fields))).alias("evidence"))


def entity_signals(rows: DataFrame, key: str, anchor: int, step: int = HOUR, last: int = 50, evidence: int = 5, half_life: int = 6 * HOUR) -> DataFrame:
    """A signal for each key and step of stream time in which it was mentioned, over its last mentions up to then.

    ``rows``: ``t, seq``, the key, ``event_class, outlet, region, sentiment, relevance, event_confidence, severity, raw``. A row on a boundary belongs to the next
    step. A signal is as of its step's end; those of the stream's last step are as of its last row. Sentiment halves every ``half_life``, up to that moment.
    Equal impacts go by ``seq``, equal votes to the class seen first. Null regions are in no set; a table without rows gives none.
    """
    stepped = rows.withColumn("step", F.floor((F.col("t") - anchor) / step))
    end_t = stepped.agg(F.max("step").alias("_last_step"), F.max("t").alias("_last_t"))  # one row
    placed = running_total(stepped, [key], "step", [F.col("t"), F.col("seq")], None, "n").withColumn("n", F.col("n") + 1)  # the place in the key's life
    ends = placed.groupBy(key, "step").agg(F.max("n").alias("end"))
    # The last mentions of a step's end are a range of places; cells of ``last`` places make it an equi-join.
    cells = ends.withColumn("cell", F.explode(F.array(F.floor(F.col("end") / last), F.floor(F.col("end") / last) - 1)))
    near = cells.join(placed.drop("step").withColumn("cell", F.floor(F.col("n") / last)), [key, "cell"])
    near = near.where((F.col("n") <= F.col("end")) & (F.col("n") > F.col("end") - last))
    votes = near.groupBy(key, "step", "event_class").agg(F.count("*").alias("votes"), F.min("n").alias("first"))
    modal = votes.groupBy(key, "step").agg(F.max_by("event_class", F.struct("votes", -F.col("first"))).alias("modal_class"))
    # At most ``last`` rows meet in a group here, so arrays of a signal's mentions are bounded.
    strength = F.struct((-F.col("raw")).alias("weaker"), "seq", "severity", "event_confidence")
    facts = near.groupBy(key, "step").agg(
        F.count("*").alias("mentions"),
        F.count_distinct("outlet").alias("outlets"),
        F.array_sort(F.collect_set("region")).alias("regions"),
        F.slice(F.array_sort(F.collect_list(strength)), 1, evidence).alias("_best"),
    )
    weight = F.greatest("relevance", F.lit(0.001)) * F.greatest("event_confidence", F.lit(0.1))
    state = ewma(stepped.select(key, "t", "seq", "step", "sentiment", "relevance", "event_confidence"), key, "sentiment", weight, half_life)
    state = state.groupBy(key, "step").agg(F.max_by(F.struct("t", "level", "den"), F.struct("t", "seq")).alias("_state"))
    out = facts.join(modal, [key, "step"]).join(state, [key, "step"]).crossJoin(F.broadcast(end_t))  # end_t: one row
    as_of = F.when(F.col("step") == F.col("_last_step"), F.col("_last_t")).otherwise(F.lit(anchor) + (F.col("step") + 1) * step)
    top = F.get("_best", F.lit(0))
    out = out.withColumns({
        "as_of": as_of,
        "top_seq": top["seq"],
        "impact": top["severity"],
        "top_confidence": top["event_confidence"],
        "evidence": F.transform("_best", lambda e: e["seq"]),
        "sentiment": F.col("_state.level"),
    })
    left = F.col("_state.den") * F.pow(F.lit(2.0), (F.col("_state.t") - F.col("as_of")) / F.lit(float(half_life)))
    return out.withColumn("confidence", 1 - F.exp(-left / 3)).drop("_best", "_state", "_last_step", "_last_t")


def event_signals(rows: DataFrame, story: str, sectors: dict[str, str], saturation: float = 3.0, bonus_cap: int = 10, evidence: int = 5) -> DataFrame:
    """A signal per story: class by confidence-weighted vote, mean sentiment, severity of its strongest mention and breadth.

    ``sectors``: sector by ticker; a ticker without one adds none. ``entity`` is the story's ticker if it has but one, else null. Of equal
    votes the class seen first wins, of equal impacts the row with the smallest ``seq``; null classes, tickers and regions are in no set.
    """
    # A story may hold a third of all rows: counts, sums and maxima are combined before the shuffle, and ranks are cut there.
    votes = rows.groupBy(story, "event_class").agg(F.sum("event_confidence").alias("w"), F.min("seq").alias("first"), F.max("event_confidence").alias("surest"))
    modal = votes.groupBy(story).agg(F.max_by(F.struct("event_class", "w", "surest"), F.struct(F.round("w", 9), -F.col("first"))).alias("_m"), F.sum("w").alias("_all"))
    best = top_evidence(rows, [story], "raw", ["seq", "severity"], evidence)
    facts = rows.groupBy(story).agg(
        F.count("*").alias("mentions"),
        F.avg("sentiment").alias("sentiment"),
        F.count_distinct("outlet").alias("outlets"),
        F.array_sort(F.collect_set("ticker")).alias("tickers"),
        F.array_sort(F.collect_set("region")).alias("regions"),
    )
    of = F.create_map(*[F.lit(x) for kv in sectors.items() for x in kv]) if sectors else F.create_map().cast("map<string,string>")
    named = F.array_sort(F.array_distinct(F.array_compact(F.transform("tickers", lambda x: F.try_element_at(of, x)))))
    bonus = F.when(F.col("outlets") >= 10, 2).when(F.col("outlets") >= 5, 1).otherwise(0)
    share = F.col("_m.w") / F.greatest("_all", F.lit(1e-9))
    out = facts.join(modal, story).join(best, story)
    return out.select(
        story, "mentions", "sentiment", "outlets", "tickers", "regions", named.alias("sectors"),
        F.when(F.size("tickers") == 1, F.get("tickers", F.lit(0))).alias("entity"),
        F.col("_m.event_class").alias("event_class"),
        F.least(F.lit(bonus_cap), F.get("evidence", F.lit(0))["severity"] + bonus).alias("impact"),
        (share * F.col("_m.surest")).alias("event_confidence"),
        (share * (1 - F.exp(-F.col("mentions") / saturation))).alias("confidence"),
        F.transform("evidence", lambda e: e["seq"]).alias("evidence"),
    )


def event_updates(rows: DataFrame, story: str, most_outlets: int = 20) -> DataFrame:
    """Rows at which a story's state (impact so far, outlets so far) changes, from its second mention on.

    An outlet counts from its first mention in the story, so the state is running sums and maxima alone.
    """
    first = F.row_number().over(Window.partitionBy(story, "outlet").orderBy("t", "seq")) == 1
    order = Window.partitionBy(story).orderBy("t", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_first", first.cast("int"))
    state = F.struct(F.max("severity").over(upto).alias("impact"), F.least(F.lit(most_outlets), F.sum("_first").over(upto)).cast("int").alias("outlets"))
    out = out.withColumn("state", state).withColumn("n", F.row_number().over(order))
    shown = F.when(F.col("n") >= 2, F.col("state"))
    out = out.withColumn("shown", shown).withColumn("before", F.lag(shown).over(order))
    return out.where(F.col("shown").isNotNull() & ~F.col("shown").eqNullSafe(F.col("before"))).select(
        story, "seq", F.col("state.impact").alias("impact"), F.col("state.outlets").alias("outlets")
    )


def signal_id(*parts: Column) -> Column:
    """A name from the parts, the same for the same parts; null parts are left out."""
    return F.concat(F.lit("sig_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))
