from collections import Counter, defaultdict
from random import Random

import numpy as np
import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

from quillrisk.operators import backtest, features, learning, market, stories
from quillrisk.plans import learned_queries as L
from quillrisk.plans import queries, risk_queries  # noqa: F401  registers
from quillrisk.session import table
from quillrisk.streaming import polls

HOUR = 3_600_000_000


def brute_stories(rows, threshold, window=48 * HOUR, retention=72 * HOUR):
    """rows: (seq, t, vector) in order; all stories are kept and tested for age."""
    open_, out = [], {}
    for seq, t, v in rows:
        v, best, most, novelty = np.array(v), None, -2.0, 1.0
        for s in open_:
            near = float(s["c"] @ v)
            if t - s["last"] <= retention and t - s["kept"] <= retention + HOUR // 2:
                novelty = min(novelty, max(0.0, 1 - near))
            if t - s["last"] <= window and near > most:
                best, most = s, near
        if best is not None and most >= threshold:
            c = best["c"] * best["n"] + v
            best |= {"c": c / np.linalg.norm(c), "n": best["n"] + 1, "last": t, "kept": t}
            out[seq] = best["name"], False
        else:
            open_.append({"c": v, "n": 1, "last": t, "kept": t, "name": f"evt_{str(seq)[:12]}"})
            out[seq] = open_[-1]["name"], True
    return out


def test_stories_against_brute_force_and_stream(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows, t = [], 0
    for i in range(250):
        t += int(rng.choice([0, 1, 5, 40, 80], p=[0.2, 0.5, 0.2, 0.07, 0.03])) * HOUR
        v = centres[rng.integers(6)] + rng.normal(size=8) * 0.4
        rows.append((i, t, "a" if i % 3 else None, (v / np.linalg.norm(v)).tolist()))
    df = spark.createDataFrame([*rows, (999, 0, "a", None)], "seq long, t long, block string, vector array<double>")
    got = {r.seq: (r.story, r.new) for r in stories.cluster_stories(df, "block", 0.8).collect()}
    want = {}
    for block in ("a", None):
        want |= brute_stories([(s, t, v) for s, t, b, v in rows if b == block], 0.8)
    assert got == want and 10 < sum(new for _, new in want.values()) < 240
    assert stories.cluster_stories(df.limit(0), "block").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_cells_are_the_single_pass_on_separate_stories(spark, seed):
    """A block that never pauses over 60 days: stories come, pause for up to 60 hours, and go."""
    rng = np.random.default_rng(seed)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    rows, i = [], 0
    for k in range(14):
        t = int(rng.integers(0, 20 * 24)) * HOUR
        for _ in range(int(rng.integers(5, 60))):
            t += int(rng.choice([0, 1, 7, 30, 47, 49, 60])) * HOUR
            v = centres[k] + rng.normal(size=16) * 0.05
            rows.append((i, t, "a" if k % 7 else None, (v / np.linalg.norm(v)).tolist()))
            i += 1
    df = spark.createDataFrame([*rows, (9999, 0, "a", None)], "seq long, t long, block string, vector array<double>").repartition(3)
    key = lambda out: {r.seq: (r.story, r.new) for r in out.collect()}
    want = key(stories.cluster_stories(df, "block", 0.7))
    for hours in (20, 96):
        assert key(stories.story_cells(df, "block", 0.7, cell_hours=hours)) == want
    assert 14 < len({s for s, _ in want.values()}) < 300 and max(t for _, t, *_ in rows) > 30 * 24 * HOUR
    assert stories.story_cells(df.limit(0), "block").count() == 0


def test_cells_on_the_given_vectors(spark):
    rows = L._vectors(table(spark, MEDIUM, "embeddings")).withColumn("block", F.lit("all"))
    exact = {r.seq: r for r in stories.cluster_stories(rows, "block", 0.3).collect()}
    cells = {r.seq: r for r in L.e4_cluster_stories(spark, MEDIUM).collect()}
    assert exact.keys() == cells.keys()
    assert sum(exact[s].new == cells[s].new for s in exact) >= 0.9 * len(exact)
    assert sum(abs(exact[s].novelty - cells[s].novelty) < 0.1 for s in exact) >= 0.9 * len(exact)


def brute_two_key(rows):
    seen, out = set(), {}
    for t, seq, url, head in sorted(rows):
        keys = ({("u", url)} if url else set()) | {("h", head)}
        out[seq] = bool(head.strip()) and not keys & seen
        if out[seq]:
            seen |= keys
    return out


def test_two_keys_and_polls(spark):
    rng = Random(4)
    rows = [(rng.randrange(60), i, rng.choice([None, "", *"abcdefghij"]), rng.choice(["", " ", *"klmnopqrstuvw"])) for i in range(120)]
    df = spark.createDataFrame([(s, t, u, h) for t, s, u, h in rows], "seq long, t long, url string, headline string")
    got = {r.seq: r.kept for r in polls.drop_seen_two_key(df, "url", "headline", ["t", "seq"]).collect()}
    assert got == brute_two_key(rows)

    store = polls.Polls(spark, df.withColumn("source", F.lit("s")).schema)
    first, second = df.where("seq < 60").withColumn("source", F.lit("s")), df.where("seq >= 60").withColumn("source", F.lit("s"))
    for _ in range(2):  # a poll that is repeated replaces itself
        store.poll(first, 0)
        store.poll(second, 1)
    kinds = {r.seq: r.kind for r in store.rows().collect()}
    latest = max(t for t, s, *_ in rows if kinds[s] == "kept" and s < 60)
    keys = lambda r: ({("u", r[2])} if r[2] else set()) | {("h", r[3])}
    seen, want = set(), {}
    for part in (rows[:60], rows[60:]):
        for r in sorted(part):
            if not r[3].strip() or keys(r) & seen:
                want[r[1]] = "duplicate"
                continue
            seen |= keys(r)
            want[r[1]] = "late" if part is not rows[:60] and r[1] >= 60 and r[0] < latest else "kept"
    assert kinds == want and Counter(want.values())["late"] and "kept" in want.values()
    counts = {r.poll: r for r in store.metrics().collect()}
    assert [counts[k].fetched for k in (0, 1)] == [60, 60] and sum(counts[k].late for k in (0, 1)) == Counter(want.values())["late"]


def test_daily_level_outlasts_quiet_days(spark):
    day = 86_400_000_000
    rows = [("a", 0, 0.5, 1.0), ("a", 200 * day, -0.2, 1.0), ("b", 3 * day, 0.1, 1.0), ("b", 3 * day, -0.3, 1.0)]
    df = spark.createDataFrame(rows, "key string, t long, s double, w double")
    got = {(r.key, r.day): r for r in features.daily_sentiment(df, "key", "t", "s", "w").collect()}
    assert len(got) == 402 and all(got["a", d].level == pytest.approx(0.5) for d in (0, 71, 72, 73, 150, 199)) and got["a", 200].level == pytest.approx(-0.2)
    assert got["b", 2].level == 0 and got["b", 3].level == pytest.approx(-0.1) and (got["b", 3].net, got["b", 4].net, got["a", 0].net) == (-1 + 0, 0, 1)
    assert got["a", 100].confidence == pytest.approx(0, abs=1e-12)
    wide = {(r.key, r.day): r for r in features.daily_sentiment(df, "key", "t", "s", "w", half_life=72.0).collect()}
    assert wide["a", 3].confidence > got["a", 3].confidence


def test_asof_over_blocks(spark):
    rng = Random(6)
    series = [(rng.choice("ab"), rng.randrange(0, 4000), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(80)] + [("c", 3999, 7.0)]
    series = list({(k, t): (k, t, v) for k, t, v in series}.values())
    points = [(rng.choice("abcd"), rng.randrange(0, 4400)) for _ in range(200)]
    date = lambda df: df.withColumn("t", F.date_from_unix_date("t"))
    a, b = date(spark.createDataFrame(points, "symbol string, t int")), date(spark.createDataFrame(series, "symbol string, t int, value double"))
    got = Counter((r.symbol, (r.t - __import__("datetime").date(1970, 1, 1)).days, r.value) for r in market.asof_values(a, b, days=100).collect())
    want = Counter((k, t, max(((u, v) for s, u, v in series if s == k and u <= t and v is not None), default=(0, None))[1]) for k, t in points)
    assert got == want


def test_backtest_rules(spark):
    days = np.random.default_rng(5).normal(0, 0.02, (40, 4))
    rows = [(d, "abcd"[k], float(days[d, k]), float(np.sin(d + k)), 0.8, int(k - 1)) for d in range(40) for k in range(4)]
    panel = backtest.panel(spark.createDataFrame(rows, "day long, name string, ret double, level double, confidence double, net long"), "day", "name", "ret", "level", "confidence", "net")
    setting = (2.0, 0.02, 0.1, 0.5, 0.05, 5.0, 0.05)
    settings = spark.createDataFrame([(s, s, *setting) for s in backtest.STRATEGIES] + [("flat", "sentiment_tilt", 0.0, *setting[1:])], "setting string, strategy string, " + ", ".join(f"{c} double" for c in backtest.SETTING))
    got = defaultdict(list)
    for r in backtest.run_backtest(panel, settings).orderBy("day").collect():
        got[r.setting].append(r)
    held = np.prod(1 + days[1:], axis=0).mean()
    assert np.prod([1 + r.net_ret for r in got["equal_weight_buy_hold"]]) == pytest.approx(held) and all(r.turnover == 0 for r in got["equal_weight_buy_hold"])
    assert all(r.gross == pytest.approx(days[r.day].mean()) for r in got["equal_weight_rebalanced"])
    assert max(r.turnover for r in got["sentiment_tilt"]) <= 0.05 + 1e-12 and all(r.cost == pytest.approx(r.turnover * 0.0005) for r in got["sentiment_tilt"])
    assert all(len(v) == 39 for v in got.values())
    found = backtest.calibrate_kappa(panel, 0.03, 0.02, 0.1, 0.5).first()
    assert found.reachable and found.achieved == pytest.approx(0.03, abs=1e-4)
    out = backtest.calibrate_kappa(panel, 0.9, 0.02, 0.1, 0.5).first()
    assert not out.reachable and out.kappa == 100
    with pytest.raises(ValueError):
        backtest.capped(np.full(4, 0.25), 0.3, 0.5)


def test_classifier_learns_and_its_confidence_is_a_probability(spark):
    rng = Random(8)
    words = {"x": ["gain", "rise", "up"], "y": ["loss", "fall", "down"], "z": ["hold", "same", "flat"]}
    rows = [(i, [rng.choice(words[k]) if rng.random() < 0.7 else rng.choice(["the", "of", "a"]) for _ in range(8)], k, i // 3, i % 10 == 0) for i, k in enumerate(rng.choice("xxxyz") for _ in range(240))]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>, label string, grp long, gold boolean")
    vectors = learning.embed(docs, "id", "tokens").join(docs.drop("tokens"), "id")
    model = learning.train_classifier(vectors, "label", "grp", "gold")
    got = model.predict(vectors).collect()
    assert np.mean([r.predicted == r.label for r in got]) > 0.95 and all(1 / 3 - 1e-9 <= r.confidence <= 1 + 1e-9 for r in got)
    folds = vectors.select("grp", learning.fold_of("grp", 3).alias("f")).distinct().groupBy("grp").count().collect()
    assert {r["count"] for r in folds} == {1}
    scores = learning.cross_validate(vectors, "label", "grp", {"a": 4.0, "b": 1e-6}, seeds=1)
    chosen = {r.candidate: r for r in features.one_se(scores, "candidate", "macro_f1", "candidate").collect()}
    assert scores.count() == 6 and chosen["a"].chosen and chosen["a"].mean > chosen["b"].mean
    weights = learning.balanced(docs, "label").groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(80) for r in weights)


def test_names_are_registered():
    assert {"c6_drop_seen_two_key", "d12_embed", "d13_train_classifier", "d17_grouped_cv", "e4_cluster_stories", "e12_score_trees", "e13_train_impact", "g16_stress_many", "i1_poll_sources", "i3_drop_late", "i4_stream_scores", "i5_stream_stories", "i10_stream_metrics"} <= set(queries.QUERIES)
