"""Feed rules, link policies, model adapters, daily sessions, grids and validation helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrisk.functions.text import normal_phrase
from quillrisk.operators.fuzzy import close_texts, near_vectors
from quillrisk.operators.impact import raw_impact
from quillrisk.session import durable, shared_dir

DAY = 86_400_000_000


def link_basis(title: Column, org: Column, word: Column, theme: Column) -> Column:
    """Why a record is kept: its title, else an organisation, else a market word together with a theme; else null."""
    return F.when(title, "title").when(org, "org").when(word & theme, "market")


def gate_reason(basis: Column, theme: Column) -> Column:
    """Why a record goes, or what it is kept for; a null basis has no link."""
    return F.when(basis.isNull(), "no link").when(basis == "org", "org only").when((basis == "market") & ~theme, "no theme").otherwise(F.concat(F.lit("kept: "), basis))


def time_window(rows: DataFrame, time: str, start: int, end: int) -> DataFrame:
    """Rows of ``[start, end)``."""
    return rows.where((F.col(time) >= start) & (F.col(time) < end))


def org_match(rows: DataFrame, id_col: str, orgs: str, aliases: DataFrame, each: float = 0.5) -> DataFrame:
    """``(id, ticker, bonus)``: ``each`` for every organisation whose normal form is one of ``aliases (org, ticker)``."""
    one = rows.select(id_col, F.explode(orgs).alias("_org")).select(id_col, F.trim(normal_phrase(F.col("_org"))).alias("org"))
    return one.join(aliases, "org").groupBy(id_col, "ticker").agg((F.count("*") * each).alias("bonus"))


def exclude_similar(pool: DataFrame, known: DataFrame, id_col: str, vector: str, text: str, threshold: float, title: str | None = None, ratio: float = 0.9) -> DataFrame:
    """Rows of ``pool`` that are like no row of ``known``: not its id, not its text, no cosine of ``threshold`` or more to any, and no ``title`` within
    ``1 - ratio`` edits a letter.

    ``known`` is a stated set of queries. Vectors meet the clusters of known ones that they can reach, titles those that share a rare run of
    letters. Null texts, titles and vectors match nothing; without known rows all of the pool stays.
    """
    known = durable(known, "known")
    rest = durable(pool.join(known.select(id_col).distinct(), id_col, "left_anti").join(known.select(text).distinct(), text, "left_anti"), "pool")
    near = near_vectors(rest, known, id_col, vector, threshold).select(F.col("id").alias(id_col))
    rest = rest.join(near, id_col, "left_anti")
    if title:
        rest = rest.join(close_texts(rest, known, id_col, title, ratio).select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")
    return rest.select(*pool.columns)


def merge_labels(found: DataFrame, given: DataFrame, market: str, relevance: float = 0.3) -> DataFrame:
    """Links found in the text and given labels that were not found again; the market's link goes where there is another."""
    rest = given.join(found.select("id", "ticker"), ["id", "ticker"], "left_anti").withColumn("relevance", F.lit(relevance))
    both = found.select("id", "ticker", "relevance").union(rest.select("id", "ticker", "relevance"))
    others = F.count("*").over(Window.partitionBy("id"))
    return both.withColumn("_n", others).where((F.col("ticker") != market) | (F.col("_n") == 1)).drop("_n")


def social_links(own: DataFrame, found: DataFrame, universe: list[str], relevance: float = 0.3) -> DataFrame:
    """A post links to its own ticker alone, with the text's relevance if it names it; posts off the universe go."""
    rows = own.where(F.col("ticker").isin(*universe)).join(found.select("id", "ticker", F.col("relevance").alias("_r")), ["id", "ticker"], "left")
    return rows.select("id", "ticker", F.coalesce("_r", F.lit(relevance)).alias("relevance"), F.col("_r").isNull().alias("relinked"))


def topic_class(topic: Column, classes: dict[str, str], conditional: dict[str, tuple[str, str]], phrase: Column) -> Column:
    """Class of a topic; conditional topics also need a cue in the phrase; others are null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, label in classes.items():
        out = out.when(topic == name, label)
    for name, (label, cue) in conditional.items():
        out = out.when((topic == name) & F.contains(phrase, F.lit(cue)), label)
    return out


def lexicon_model(tokens: Column, positive: list[str], negative: list[str], prior: int) -> Column:
    """P(positive) - P(negative) from two word lists, ``prior`` pseudo-hits being neutral; 0 without hits or text."""
    count = lambda words: F.size(F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t.isin(*words)))
    p, n = count(positive), count(negative)
    return F.when(p + n > 0, (p - n) / (p + n + prior)).otherwise(0.0)


def score_with_model(rows: DataFrame, id_col: str, text_col: str, model) -> DataFrame:
    """``(id, score)`` by any picklable model from a series of texts to scores, in Arrow batches; null texts are passed as they are."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({id_col: part[id_col], "score": model(part[text_col])})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, score double")


def zero_shot(tokens: Column, labels: list[str], none: str) -> tuple[Column, Column]:
    """The label of most tokens (the first among equals) and its share of all labels' tokens."""
    count = lambda w: F.size(F.filter(tokens, lambda t: t == w))
    hits = F.array(*[F.struct(count(w).alias("n"), F.lit(-k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(labels)])
    total, best = F.aggregate(hits, F.lit(0), lambda s, h: s + h["n"]), F.array_max(hits)
    some = total > 0
    return F.when(some, best["w"]).otherwise(none), best["n"] / F.greatest(total, F.lit(1))


def one_se(scores: DataFrame, candidate: str, score: str, simplest: str) -> DataFrame:
    """Mean and standard error of each candidate over its folds; ``chosen``: the simplest within one error of the best."""
    s = scores.groupBy(candidate).agg(F.avg(score).alias("mean"), (F.stddev_samp(score) / F.sqrt(F.count("*"))).alias("se"))
    best = F.first(F.col("mean") - F.col("se")).over(Window.orderBy(F.desc("mean"), candidate))  # a row a candidate
    order = Window.orderBy(F.col("mean") < F.col("_least"), simplest)
    return s.withColumn("_least", best).withColumn("chosen", F.row_number().over(order) == 1).drop("_least")


def training_set(parts: list[DataFrame], gold: DataFrame, cap: int, other: str = "OTHER", seed: str = "0") -> DataFrame:
    """Union of ``(doc_id, text, label)`` parts: a text's first part wins, texts of ``gold`` go, and ``other`` has at most ``cap`` rows."""
    rows = None
    for place, part in enumerate(parts, 1):
        part = part.select("doc_id", "text", "label").withColumn("place", F.lit(place))
        rows = part if rows is None else rows.union(part)
    rows = rows.where("label IS NOT NULL").join(gold.select("text").distinct(), "text", "left_anti")
    rows = rows.groupBy("text").agg(F.min_by(F.struct("doc_id", "label", "place"), F.struct("place", "doc_id")).alias("r")).select("text", "r.*")
    turn = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":" + seed)))
    capped = rows.where(F.col("label") == other).withColumn("_t", turn).orderBy("_t", "doc_id").limit(cap).drop("_t")
    return rows.where(F.col("label") != other).union(capped)


def recompute(stored: DataFrame, payload: str, names: list[str], prior: Column) -> DataFrame:
    """Add ``raw`` from the JSON map of drivers that was stored with each mention."""
    m = F.from_json(payload, "map<string,double>")
    return stored.withColumn("_m", m).withColumn("raw", raw_impact(prior, {n: F.col("_m")[n] for n in names}, F.col("relevance"))).drop("_m")


def daily_sentiment(rows: DataFrame, key: str, t: str, sentiment: str, weight: str, band: float = 0.15, half_life: float = 24.0) -> DataFrame:
    """``(key, day, net, level, confidence)`` for every day of the table and every key, 0 before a key's first mention.

    Level: mean sentiment whose weights halve every ``half_life`` hours up to the day's end; on days without a mention it stays what it was, while
    the confidence fades. Days are summed first; a day with mentions looks back as far as weights reach in a double's precision,
    and a window over a row a day carries the last such day on, so no key is one task.
    """
    per_day = 24.0 / half_life
    reach = int(72 / per_day) + 1
    day = F.floor(F.col(t) / DAY)
    fade = F.col(weight) * F.pow(F.lit(2.0), (F.col(t) - (F.col("day") + 1) * DAY) / float(DAY) * per_day)
    vote = F.when(F.col(sentiment) > band, 1).when(F.col(sentiment) < -band, -1).otherwise(0)
    days = rows.withColumn("day", day).groupBy(key, "day").agg(F.sum(vote).alias("net"), F.sum(fade * F.col(sentiment)).alias("num"), F.sum(fade).alias("den"))
    later = days.select(key, "num", "den", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("_later"), "day")
    later = later.select(key, (F.col("day") + F.col("_later")).alias("day"), *[(F.col(c) * F.pow(F.lit(2.0), -F.col("_later") * per_day)).alias(c) for c in ("num", "den")])
    sums = later.join(days.select(key, "day", "net"), [key, "day"]).groupBy(key, "day").agg(F.first("net").alias("net"), F.sum("num").alias("num"), F.sum("den").alias("den"))
    span = rows.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    keys = days.select(key).distinct().crossJoin(F.broadcast(span)).select(key, F.explode(F.sequence("_a", "_b")).alias("day"))  # span: one row
    last = F.last(F.when(F.col("den").isNotNull(), F.struct("day", "num", "den")), ignorenulls=True).over(Window.partitionBy(key).orderBy("day"))
    out = keys.join(sums, [key, "day"], "left").withColumn("_l", last)
    den = F.coalesce(F.col("_l.den") * F.pow(F.lit(2.0), (F.col("_l.day") - F.col("day")) * per_day), F.lit(0.0))
    return out.select(
        key, "day", F.coalesce("net", F.lit(0)).cast("long").alias("net"), F.coalesce(F.col("_l.num") / F.col("_l.den"), F.lit(0.0)).alias("level"), (1 - F.exp(-den / 3)).alias("confidence")
    )


def buy_and_hold(prices: DataFrame, symbol: str, time: str, close: str) -> DataFrame:
    """``(time, value, ret)`` of equal sums put into all symbols at their first closes."""
    grown = prices.withColumn("_g", F.col(close) / F.first(close).over(Window.partitionBy(symbol).orderBy(time)))
    value = grown.groupBy(time).agg(F.avg("_g").alias("value"))
    return value.withColumn("ret", F.col("value") / F.lag("value").over(Window.orderBy(time)) - 1)  # a row a session


def tilt_grid(rows: DataFrame, day: str, base: str, level: str, confidence: str, kappas: list[float]) -> DataFrame:
    """Tilted weights for every kappa in one job; levels are kept within -1 and 1."""
    each = rows.withColumn("kappa", F.explode(F.array(*map(F.lit, kappas))))
    each = each.withColumn("_w", F.col(base) * F.exp(F.col("kappa") * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), level)) * F.col(confidence)))
    return each.withColumn("weight", F.col("_w") / F.sum("_w").over(Window.partitionBy("kappa", day))).drop("_w")


def excess_over(means: DataFrame, setting: str, at: float, value: str) -> DataFrame:
    """Add ``excess``: the value over that of the row whose ``setting`` is ``at``; null without such a row."""
    base = F.max(F.when(F.col(setting) == at, F.col(value))).over(Window.partitionBy())  # a row a setting
    return means.withColumn("excess", F.col(value) - base)


def what_if(spark: SparkSession, values: dict[str, list[float]], shown: list[str]) -> DataFrame:
    """A run for every combination of the factors' values; runs are named by the factors of ``shown``."""
    rows = [dict(zip(values, combination)) for combination in product(*values.values())]
    return spark.createDataFrame([("/".join(str(r[f]) for f in shown), *r.values()) for r in rows], f"run string, {', '.join(f'{f} double' for f in values)}")


def random_baseline(sessions: DataFrame, session: str, hit: str, n: int, draws: int) -> DataFrame:
    """Mean and 95 % interval of the hit rate of ``n`` sessions drawn without replacement, by hash order."""
    each = sessions.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    turn = F.md5(F.concat(F.col(session).cast("string"), F.lit(":"), F.col("draw").cast("string")))
    drawn = each.withColumn("_n", F.row_number().over(Window.partitionBy("draw").orderBy(turn, session))).where(F.col("_n") <= n)
    rates = drawn.groupBy("draw").agg(F.avg(hit).alias("rate"))
    return rates.agg(F.avg("rate").alias("mean"), F.percentile("rate", 0.025).alias("low"), F.percentile("rate", 0.975).alias("high"))


def predicted_vs_realised(predicted: DataFrame, realised: DataFrame, factor: str, run: str, move: str) -> DataFrame:
    """Per factor: runs, share of equal signs, and mean absolute error."""
    both = predicted.select(factor, run, F.col(move).alias("_p")).join(realised.select(factor, run, F.col(move).alias("_r")), [factor, run])
    agreed = (F.signum("_p") == F.signum("_r")).cast("int")
    return both.groupBy(factor).agg(F.count("*").alias("n"), F.avg(agreed).alias("agreed"), F.avg(F.abs(F.col("_p") - F.col("_r"))).alias("error"))


def blind_sample(rows: DataFrame, id_col: str, labellers: list[str], source: str, month: str, least: int, caps: dict[str, int]) -> DataFrame:
    """``(item, id, source, month, reason)``: a sample to label by hand, ``rows`` being one row of each near-duplicate group.

    First the ``least`` rows of every class of every labeller, in an order by hash; then each source is filled up to its cap, the months in
    proportion to their rows (rounded down), what is left from any month. Picks beyond a cap stay, since classes come first. Sources without a cap are
    not filled. Null classes are classes; ``item`` numbers the sample by another hash, so that its order tells nothing. Quotas bound the result.
    """
    turn = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":0")))
    order = [turn.asc(), F.col(id_col)]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))  # noqa: E731  limits of a rank let Spark cut each group before the shuffle
    rows = durable(rows.select(id_col, F.col(source).alias("source"), F.col(month).alias("month"), *labellers), "sample-rows")  # texts are read once
    picks = [
        rows.withColumn("_n", place(c)).where(F.col("_n") <= least).select(id_col, F.struct(F.lit(k).alias("k"), F.concat_ws(":", F.lit("least"), F.lit(c), F.col(c).cast("string")).alias("reason")).alias("why"))
        for k, c in enumerate(labellers)
    ]
    first = picks[0]
    for other in picks[1:]:
        first = first.union(other)
    first = durable(first.groupBy(id_col).agg(F.min("why")["reason"].alias("reason")), "sample-classes")
    open_ = rows.join(first, id_col, "left")
    cap = F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("source"))
    months = open_.groupBy("source", "month").agg(F.count("*").alias("_rows"), F.count("reason").alias("_picked"))  # a row a source and month
    by_source = Window.partitionBy("source")
    need = F.greatest(F.lit(0), F.coalesce(cap, F.lit(0)) - F.sum("_picked").over(by_source))
    quota = months.select("source", "month", need.alias("_need"), F.floor(need * F.col("_rows") / F.sum("_rows").over(by_source)).alias("_quota"))
    rest = open_.where("reason IS NULL").drop("reason")
    # No place beyond a source's cap is ever wanted, which bounds what a month and a source send on.
    most = max(caps.values(), default=0)
    near = rest.withColumn("_n", place("source", "month")).where(F.col("_n") <= most)
    near = near.join(quota.withColumnsRenamed({"source": "_s", "month": "_m"}), F.col("source").eqNullSafe(F.col("_s")) & F.col("month").eqNullSafe(F.col("_m")))
    near = durable(near.select(id_col, "source", "month", "_need", (F.col("_n") <= F.col("_quota")).alias("_in")), "sample-months")
    took = F.sum(F.col("_in").cast("int")).over(by_source)
    left = near.withColumn("_left", F.col("_need") - took).withColumn("_n", F.row_number().over(Window.partitionBy("source", "_in").orderBy(*order)))
    fill = left.where(F.col("_in") | (F.col("_n") <= F.col("_left")))
    fill = fill.select(id_col, "source", "month", F.when(F.col("_in"), F.concat_ws(":", F.lit("fill"), "source", F.col("month").cast("string"))).otherwise(F.concat_ws(":", F.lit("fill"), "source", F.lit("remainder"))).alias("reason"))
    sample = open_.where("reason IS NOT NULL").select(id_col, "source", "month", "reason").union(fill)
    number = F.row_number().over(Window.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":item"))), id_col))  # the sample alone, bounded by quotas
    return sample.select(F.concat(F.lit("H"), F.lpad(number.cast("string"), 4, "0")).alias("item"), id_col, "source", "month", "reason")


def publish(spark: SparkSession, sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """Write ``(name, value)`` rows section by section into one table; a section replaces what it held before."""
    path = f"{shared_dir(spark)}/quillrisk/metrics-{uuid.uuid4().hex}"
    for section, rows in sections:
        out = rows.select("name", "value").withColumn("section", F.lit(section))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section").parquet(path)
    return spark.read.schema("name string, value double, section string").parquet(path).select("section", "name", "value")
