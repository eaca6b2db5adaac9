import zlib
from random import Random

import numpy as np
import pyarrow as pa
from conftest import MEDIUM
from llm.helpers import SCHEMA, awkward

from quillrisk.llm import toxicity
from quillrisk.llm._tokens import slices
from quillrisk.llm.queries import op10_recurrent_toxicity
from quillrisk.session import table


def test_gradients():
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    (w,) = slices(pa.array(["a bad word here", "fine words all along the way", "", "x"]), True)
    v = toxicity._vocabulary(w)
    text, start = toxicity._windows(w.counts)
    index, here = toxicity._window_words(w, v, text, start)
    y = np.array([1.0, 0, 0, 1])

    def loss():
        p = toxicity._sigmoid(net.logits(net.project(net.inputs(v)), index, here))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = net.gradients(v, net.inputs(v), index, here, y)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        p = net.p[name]
        if isinstance(g, tuple):
            dense = np.zeros_like(p)
            np.add.at(dense, g[0], g[1])
            g = dense
        places = np.argwhere(np.abs(g) > 1e-7)
        for at in places[rng.permutation(len(places))[:6]]:
            at, old = tuple(at), p[tuple(at)]
            p[at] = old + 1e-3
            up = loss()
            p[at] = old - 1e-3
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-3 - g[at]) <= 2e-3 * max(1e-2, abs(g[at])), (name, at)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        text, start = toxicity._windows(np.array([n]))
        seen = {p for s in start for p in range(s, min(n, s + toxicity.WINDOW))}
        assert seen == set(range(n)) and len(start) == max(1, 1 + -(-(n - 32) // 16))


def test_planted_words_are_found_anywhere(spark):
    rng = Random(1)
    make = lambda bad, n: " ".join(f"w{rng.randrange(300)}" if not bad or k not in bad else f"vile{rng.choice('abcdefg')}" for k in range(n))
    rows = [(i, make({rng.randrange(100)} if i % 2 else (), 100), None, None, 0, 0, 0, "") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows] + [(3, 0), (5, None)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    far = make((), 3000)
    tests = pa.array([far, far + " vilez " + far, None, ""])
    s = net.scores(tests)
    assert s[0] < 0.5 < 0.7 <= s[1] and s[2] == s[3] < 0.7


def test_held_out_accuracy(spark):
    toxic = {r.doc_id: r.toxic for r in table(spark, MEDIUM, "labels").collect()}
    rows = [r for r in op10_recurrent_toxicity(spark, MEDIUM).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and toxic.get(r.doc_id) is not None]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) >= 0.9


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    got = toxicity.score(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.fit(docs, labels.where("toxic = 1")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(spark.createDataFrame([], SCHEMA), net).count() == 0


def plain_score(net, text):
    """One text in loops: words, n-grams, both directions, attention, the worst window."""
    import re

    words = re.findall(r"[^ \t\n\x0b\x0c\r!-/:-@\[-`{-~]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sig = lambda z: 1 / (1 + np.exp(-z))
    vectors = []
    for word in words:
        (w,) = slices(pa.array([word]), True)
        v = toxicity._vocabulary(w)
        line = b"^" + word.encode() + b"$"
        grams = []
        for n in (3, 4):
            for i in range(len(line) - n + 1):
                code = n
                for b in line[i : i + n]:
                    code = (code ^ b) * 0x01000193 & 0xFFFFFFFF
                    code ^= code >> 15
                grams.append((code * 0x9E3779B1 & 0xFFFFFFFF) >> 16)
        assert sorted(grams) == sorted(v.grams.tolist())
        vectors.append(net.p["words"][v.word[0]] + sum(net.p["grams"][g] for g in grams) / len(grams))
    h_size, best = toxicity.HIDDEN, -np.inf
    for s in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP):
        part = vectors[s : s + toxicity.WINDOW]
        states = {}
        for d, line in (("f", part), ("b", part[::-1])):
            h, out = np.zeros(h_size), []
            for x in line:
                a, u = x @ net.p[f"W{d}"] + net.p[f"c{d}"], h @ net.p[f"U{d}"]
                z, r = sig(a[:h_size] + u[:h_size]), sig(a[h_size : 2 * h_size] + u[h_size : 2 * h_size])
                c = np.tanh(a[2 * h_size :] + r * u[2 * h_size :])
                h = z * h + (1 - z) * c
                out.append(h)
            states[d] = out if d == "f" else out[::-1]
        both = [np.concatenate(p) for p in zip(states["f"], states["b"])]
        e = np.exp([b @ net.p["v"] for b in both])
        pooled = sum(x * b for x, b in zip(e / e.sum(), both)) if both else np.zeros(2 * h_size)
        best = max(best, float(pooled @ net.p["w"] + net.p["b"][0]))
    return float(sig(best - net.p["shift"][0]))


def test_scores_against_plain_loops():
    net, rng = toxicity.Network(5), Random(2)
    net.p["shift"] = np.array([0.3])
    texts = ["", None, "one", "é ß! two", *[" ".join(rng.choice(["alpha", "Beta", "ga-mma", "δέλτα", "x" * 40]) for _ in range(n)) for n in (31, 32, 33, 47, 48, 49, 120)]]
    got = net.scores(pa.array(texts))
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-4)
