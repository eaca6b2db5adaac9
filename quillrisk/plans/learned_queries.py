"""Registered queries: stories, text vectors, classifiers, the impact model, backtests, polls and stateful streams."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrisk.functions import text as X
from quillrisk.operators import backtest, boosting, evaluation, features, learning, stories
from quillrisk.plans import models as M
from quillrisk.plans.queries import query
from quillrisk.session import durable, shared_dir, table
from quillrisk.streaming import ordered, polls, sources

DAY = 86_400_000_000
HOUR = 3_600_000_000


# --- stories ---
def _vectors(rows):
    return rows.select(F.col("vec_id").cast("long").alias("seq"), (F.lit(M.START) + F.col("vec_id") * HOUR).alias("t"), "label", F.col("embedding").cast("array<double>").alias("vector"))


@query()
def e4_cluster_stories(spark, d):
    """One block that never pauses: every vector, an hour apart."""
    rows = _vectors(table(spark, d, "embeddings")).withColumn("block", F.lit("all"))
    return stories.story_cells(rows, "block", 0.3)


@query()
def i5_stream_stories(spark, d):
    rows = _vectors(table(spark, d, "embeddings"))
    return ordered.replay(rows, lambda s: ordered.stream_stories(s, "label", 0.3, delay="13 hours"), "stories")


# --- text models ---
def _embedded(spark, d):
    return learning.embed(M.documents(spark, d).select("doc_id", X.word_tokens(F.col("text")).alias("tokens")), "doc_id", "tokens")


@query()
def d12_embed(spark, d):
    values = vector_to_array("features")
    return _embedded(spark, d).select(F.col("id").alias("doc_id"), F.size(F.filter(values, lambda x: x != 0)).alias("terms"), F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)).alias("length"))


def _labelled(spark, d):
    docs = M.documents(spark, d).select(F.col("doc_id").alias("id"), "source")
    known = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"), (F.col("toxic") == 1).alias("gold"))
    return _embedded(spark, d).join(docs, "id").join(known, "id", "left")


@query()
def d13_train_classifier(spark, d):
    rows = durable(_labelled(spark, d), "labelled")
    model = learning.train_classifier(rows.where("label IS NOT NULL"), "label", "source", "gold")
    return model.predict(rows).select(F.col("id").alias("doc_id"), "label", "predicted", "confidence")


@query()
def d17_grouped_cv(spark, d):
    rows = _labelled(spark, d).where("label IS NOT NULL").select("features", "label", "source")
    scores = learning.cross_validate(rows, "label", "source", {"a strong": 0.25, "b weak": 4.0})
    return features.one_se(scores, "candidate", "macro_f1", "candidate").select("candidate", "mean", "se", "chosen")


# --- impact model ---
_FEATURES = ["strength", "event_confidence", "relevance", "spread"]


def _impact_rows(spark, d):
    rows = M.scored(spark, d).select("seq", "t", F.abs("sentiment").alias("strength"), "event_confidence", "relevance", F.col("outlet").cast("double").alias("spread"), "raw")
    return durable(rows.withColumn("later", F.col("t") >= M.START + 20 * DAY), "impact-rows")


#: Scores never fall along strength, confidence and relevance; the outlet's number may do what it likes.
_RULES = boosting.Rules(monotone=(1, 1, 1, 0), trees=12)


def _impact_model(spark, d):
    """The model as a table of nodes, and the rows it was trained and tested on."""
    rows = _impact_rows(spark, d)
    return durable(boosting.fit(rows, _FEATURES, "raw", "later", _RULES).trees.table(spark), "impact-model"), rows


@query()
def e12_score_trees(spark, d):
    model, rows = _impact_model(spark, d)
    return rows.select("seq", boosting.score(boosting.Trees.read(model), _FEATURES).alias("score"))


@query()
def e13_train_impact(spark, d):
    """Rank correlation of the model's score with the target before and after the time split."""
    model, rows = _impact_model(spark, d)
    scored = durable(rows.select("later", "raw", boosting.score(boosting.Trees.read(model), _FEATURES).alias("score")), "impact-scores")
    means = scored.groupBy("later").agg(F.avg("score").alias("mean_score"))
    trees = model.agg(F.max("tree")).first()[0] + 1
    return evaluation.spearman(scored, "later", "score", "raw").join(means, "later").withColumn("trees", F.lit(trees))


# --- backtests ---
def _panel(spark, d, half_life=24.0):
    rows = M.mentions(spark, d).withColumn("value", 50 * (1 + F.col("sentiment")) / (1 - F.col("sentiment")))
    closes = rows.groupBy("ticker", F.floor(F.col("t") / DAY).alias("day")).agg(F.avg("value").alias("close"))
    moves = closes.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("day")) - 1)
    signals_ = features.daily_sentiment(rows, "ticker", "t", "sentiment", "relevance", half_life=half_life)
    both = signals_.join(moves.select("ticker", "day", "ret"), ["ticker", "day"], "left")
    return backtest.panel(both, "day", "ticker", "ret", "level", "confidence", "net")


_SETTING = {"kappa": 2.0, "deadband": 0.02, "low": 0.05, "high": 0.4, "most": 0.05, "bps": 5.0, "step": 0.02}


def _settings(spark, rows):
    return spark.createDataFrame([(name, strategy, *[(_SETTING | own)[c] for c in backtest.SETTING]) for name, strategy, own in rows], "setting string, strategy string, " + ", ".join(f"{c} double" for c in backtest.SETTING))


@query()
def f15_run_backtest(spark, d):
    runs = backtest.run_backtest(_panel(spark, d), _settings(spark, [(s, s, {}) for s in backtest.STRATEGIES]))
    return runs.drop("setting")


@query()
def f16_kappa_for_target(spark, d):
    days = durable(_panel(spark, d), "panel")
    found = [backtest.calibrate_kappa(days, target, 0.02, 0.05, 0.4) for target in (0.01, 0.5)]  # the second is out of reach
    return found[0].union(found[1])


@query()
def f17_kappa_by_half_life(spark, d):
    out = None
    for half_life in (12.0, 24.0, 72.0):
        settings = _settings(spark, [(str(k), "sentiment_tilt", {"kappa": k}) for k in (0.0, 1.0, 4.0)])
        one = backtest.summary(backtest.run_backtest(_panel(spark, d, half_life), settings)).withColumn("half_life", F.lit(half_life))
        out = one if out is None else out.union(one)
    out = out.withColumn("kappa", F.col("setting").cast("double"))
    return backtest.excess_over_flat(out, "half_life").select("half_life", "kappa", "total", "excess", "turnover")


# --- polls and stateful streams ---
def _items(spark, d):
    """Mentions as items of three sources with a URL and a headline; every fiftieth comes a poll late."""
    m = M.mentions(spark, d)
    url = F.when(F.col("seq") % 9 > 0, F.concat(F.lit("https://x/"), F.col("story"), F.lit("/"), F.floor(F.col("t") / DAY)))
    headline = F.when(F.col("seq") % 97 > 0, F.concat_ws(" ", "ticker", F.col("outlet").cast("string"), F.floor(F.col("t") / (6 * HOUR)).cast("string"))).otherwise("")
    poll = F.least(F.lit(3), F.floor((F.col("t") - M.START) / (8 * DAY)) + F.when(F.col("seq") % 50 == 0, 1).otherwise(0)).cast("int")
    return m.select("seq", "t", F.concat(F.lit("source"), F.col("region") % 3).alias("source"), url.alias("url"), headline.alias("headline"), poll.alias("poll"))


@query()
def c6_drop_seen_two_key(spark, d):
    return polls.drop_seen_two_key(_items(spark, d), "url", "headline", ["t", "seq"]).select("seq", "kept")


def _polled(spark, d):
    """Four polls: a poll's files come into a folder, as many as the tasks that write them, and the stream takes what is new as one micro-batch."""
    items = durable(_items(spark, d), "items")
    base = f"{shared_dir(spark)}/quillrisk/inbox-{uuid.uuid4().hex}"
    out = polls.Polls(spark, items.drop("poll").schema)
    for number in range(4):
        items.where(F.col("poll") == number).drop("poll").write.mode("append").parquet(base)
        out.run(spark.readStream.schema(out.schema).parquet(base))
    return out


def _sources(spark, d):
    """Three sources, each a folder with a file a poll and a query of its own."""
    items = durable(_items(spark, d), "items")
    base = f"{shared_dir(spark)}/quillrisk/sources-{uuid.uuid4().hex}"
    schema = items.drop("poll", "source").schema
    for number in range(4):
        for k in range(3):
            items.where((F.col("poll") == number) & (F.col("source") == f"source{k}")).drop("poll", "source").coalesce(1).write.mode("append").parquet(f"{base}/source{k}")
    make = lambda k: lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/source{k}")
    out = sources.Supervisor(spark, schema, {f"source{k}": make(k) for k in range(3)}, counts={"without_url": "count_if(coalesce(url, '') = '')"})
    out.run()
    return out


_POLL = f"least(3, (t - {M.START}) // (8 * {DAY}) + CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END)"


@query(f"WITH {M.MENTIONS} SELECT CAST({_POLL} AS INTEGER) AS poll, 'source' || (region % 3) AS source, count(*) AS fetched FROM mentions GROUP BY 1, 2")
def i1_poll_sources(spark, d):
    return _sources(spark, d).progress().where("rows > 0").select(F.col("batch").cast("int").alias("poll"), "source", F.col("rows").alias("fetched"))


@query()
def h14_batch_latency(spark, d):
    """How long the micro-batches of each source took, from the progress that their queries report."""
    return sources.latencies(_sources(spark, d).progress())


@query()
def i3_drop_late(spark, d):
    return _polled(spark, d).rows().select("seq", "poll", "kind")


@query()
def i10_stream_metrics(spark, d):
    return _polled(spark, d).metrics()


@query(f"""WITH {M.MENTIONS} SELECT a.ticker, a.seq, count_if(b.t > a.t - {6 * HOUR}) AS recent, count(DISTINCT b.outlet) FILTER (b.t >= a.t - {6 * HOUR}) AS outlets,
    sum(b.relevance * b.sentiment * pow(2, (b.t - a.t) / {float(DAY)})) / sum(b.relevance * pow(2, (b.t - a.t) / {float(DAY)})) AS level
  FROM mentions a JOIN mentions b ON b.ticker = a.ticker AND (b.t < a.t OR (b.t = a.t AND b.seq <= a.seq)) GROUP BY 1, 2""")
def i4_stream_scores(spark, d):
    rows = M.mentions(spark, d).select("ticker", "t", "seq", "outlet", "sentiment", "relevance")
    return ordered.replay(rows, lambda s: ordered.scores(s, "ticker", delay="13 hours"), "scores")
