"""Streams in event time: what comes out does not depend on files, micro-batches or restarts; state ends."""

import random

import numpy as np
import pandas as pd
from conftest import MEDIUM
from pyspark.sql import functions as F

from quillrisk.operators import stories
from quillrisk.plans import learned_queries as L
from quillrisk.session import table
from quillrisk.streaming import ordered

HOUR = ordered.HOUR


def test_triggers_do_not_depend_on_lots(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(1, 300) * HOUR, i, rng.randrange(1, 11)) for i in range(150)]
    state, want = {}, {}
    for key, t, seq, impact in sorted(rows, key=lambda r: (r[1], r[2])):
        at, level = state.get(key, (None, 0))
        cold = at is not None and t - at < 24 * HOUR
        want[seq] = "fired" if not cold else "escalation" if impact > level else "cooldown"
        if want[seq] != "cooldown":
            state[key] = t, impact
    df = spark.createDataFrame(rows, "key string, t long, seq long, impact int")
    make = lambda s: ordered.triggers(s, "key", delay="50 hours")
    got = ordered.replay(df, make, "t", parts=2, disorder=48 * HOUR)
    assert {r.seq: r.decision for r in got.collect()} == want and got.count() == 150
    assert len(set(want.values())) == 3
    assert ordered.replay(df.limit(0), make, "t").count() == 0


def test_rows_wait_for_the_watermark_and_late_rows_go(spark):
    df = lambda *rows: spark.createDataFrame([("k", t * HOUR, s, 5) for t, s in rows], "key string, t long, seq long, impact int")
    inbox = ordered.Inbox(spark, df((0, 0)).schema, lambda s: ordered.triggers(s, "key", delay="10 hours"), "wait")
    inbox.put(df((1, 1), (40, 2)))
    inbox.run()
    assert {r.seq for r in inbox.rows().collect()} == {1}  # 40 h waits for 50 h
    inbox.put(df((5, 3), (35, 4)))  # the first is later than the delay
    inbox.run()
    assert {r.seq for r in inbox.rows().collect()} == {1}
    inbox.close(1000 * HOUR)
    assert {r.seq: r.decision for r in inbox.rows().collect()} == {1: "fired", 4: "fired", 2: "cooldown"}
    state = spark.read.format("statestore").option("path", f"{inbox.base}/checkpoint").option("stateVarName", "fired").load()
    assert state.count() == 0  # the key is forgotten


def brute_scores(rows, window, half_life):
    out = {}
    for t, seq, *_ in rows:
        before = [r for r in rows if (r[0], r[1]) <= (t, seq)]
        weights = [r[4] * 2.0 ** ((r[0] - t) / half_life) for r in before]
        level = sum(w * r[3] for w, r in zip(weights, before)) / sum(weights)
        out[seq] = (sum(r[0] > t - window for r in before), len({r[2] for r in before if r[0] >= t - window}), round(level, 9))
    return out


def test_scores(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(1, 40) * HOUR, i, f"o{rng.randrange(6)}", rng.uniform(-1, 1), rng.uniform(0.1, 1)) for i in range(80)]
    df = spark.createDataFrame([("k", *r) for r in rows], "key string, t long, seq long, outlet string, sentiment double, relevance double")
    got = ordered.replay(df, lambda s: ordered.scores(s, "key", delay="13 hours"), "scores", parts=2)
    assert {r.seq: (r.recent, r.outlets, round(r.level, 9)) for r in got.collect()} == brute_scores(rows, 6 * HOUR, 24 * HOUR)


def test_stories_stream_is_the_batch(spark):
    rows = L._vectors(table(spark, MEDIUM, "embeddings"))
    key = lambda df: {r.seq: (r.story, r.new, round(r.novelty, 9)) for r in df.collect()}
    assert key(L.i5_stream_stories(spark, MEDIUM)) == key(stories.cluster_stories(rows, "label", 0.3))


def test_hot_story_state_is_an_entry_a_story():
    """Only stories that changed are written again."""
    class Fake:
        def __init__(self):
            self.d, self.writes = {}, 0

        def exists(self):
            return bool(self.d)

        def iterator(self):
            return iter(self.d.items())

        def updateValue(self, k, v):
            self.d[k], self.writes = v, self.writes + 1

        def containsKey(self, k):
            return k in self.d

        def removeKey(self, k):
            del self.d[k]

        def get(self):
            return self.d.get("n")

        def update(self, v):
            self.d["n"] = v

    p = ordered.OpenStories(0.8, 48 * HOUR, 72 * HOUR)
    p.stories, p.born = Fake(), Fake()
    eye = np.eye(4)
    p.take(("b",), pd.DataFrame({"t": [0, 1, 2], "seq": [1, 2, 3], "vector": [eye[0], eye[1], eye[2]]}))
    assert p.stories.writes == 3
    p.take(("b",), pd.DataFrame({"t": [10], "seq": [4], "vector": [eye[1]]}))
    assert p.stories.writes == 4 and p.stories.d[("evt_2",)][2] == 2
    p.take(("b",), pd.DataFrame({"t": [73 * HOUR], "seq": [5], "vector": [eye[3]]}))
    assert set(p.stories.d) == {("evt_5",)}
