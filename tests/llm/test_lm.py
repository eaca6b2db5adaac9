import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import MEDIUM, SMALL
from llm.helpers import SCHEMA, awkward, lower, words

from pyspark.sql import functions as F

from quillrisk.llm import _attention, lm
from quillrisk.llm._tokens import slices
from quillrisk.llm.queries import op7_attention_scoring
from quillrisk.session import table


def brute_base(rows, training):
    counts = Counter()
    for i, t in rows:
        if training(i):
            counts.update([*words(lower(t)), "\n"])
    total, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        toks = [*words(lower(t)), "\n"]
        out.append((i, len(toks), sum(counts[x] > 0 for x in toks), total, sum(math.log10((counts[x] + 1) / (total + v + 1)) for x in toks)))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got, want = sorted([(r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4] for g in got], [w[4] for w in want])


def test_base_scores_with_few_and_many_sent_words(spark):
    docs = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_base(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    training = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    for sent in (50, 1 << 18):
        same(lm.score(docs, training, start_texts=20, sent_words=sent).collect(), want)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm.score(docs, F.lit(True), start_texts=5).collect()
    same(got, brute_base(rows, lambda i: True))
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    none = lm.score(docs, F.lit(False)).collect()
    same(none, brute_base(rows, lambda i: False))
    assert all(np.isfinite(r.score) for r in none)
    assert lm.score(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def small_net(near=40, seed=2):
    counts = np.append(np.sort(np.random.default_rng(seed).integers(1, 90, near))[::-1], [3, 0, 0]).astype(float)
    layout = _attention.Layout.of(np.append(counts[:near], np.zeros(3)))
    return layout, _attention.Attention(layout.bounds).init(np.append(counts[:near], 1.0), seed)


def test_gradients():
    rng = np.random.default_rng(0)
    layout, model = small_net()
    model.p = {k: p.astype(np.float64) for k, p in model.p.items()}
    read, target = rng.integers(0, 41, (3, _attention.WINDOW)), rng.integers(0, 41, (3, 16))
    weight = rng.random((3, 16)) * (rng.random((3, 16)) < 0.8)

    def loss():
        h = model.states(read, {})
        return -(model.log_p(h, target.ravel()) * weight.ravel()).sum() / weight.sum()

    for name, g in model.gradients(read, target, weight).items():
        p = model.p[name]
        if name == "E":
            dense = np.zeros_like(p)
            np.add.at(dense, g[0], g[1])
            g = dense
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p.shape)
            old, p[at] = p[at], p[at] + 1e-4
            up, p[at] = loss(), old - 1e-4
            down, p[at] = loss(), old
            assert abs((up - down) / 2e-4 - g[at]) <= 1e-3 * max(0.05, abs(g[at])), name


def test_subwords_that_are_read_often_are_multiplied_once():
    """The gradients once had a row for every place; places without weight took part in the softmax."""
    rng = np.random.default_rng(4)
    layout, model = small_net()
    read, target = rng.integers(0, 41, (30, _attention.WINDOW)), rng.integers(0, 41, (30, _attention.WINDOW))
    weight = (rng.random((30, _attention.WINDOW)) * (rng.random((30, _attention.WINDOW)) < 0.7)).astype(np.float32)
    told, log_p = [], model.log_p
    model.log_p = lambda h, *rest: told.append(len(h)) or log_p(h, *rest)
    rows, g = model.gradients(read, target, weight)["E"]
    assert rows.tolist() == np.unique(read).tolist() and g.shape == (len(rows), _attention.DIM) and told == [np.count_nonzero(weight)]
    # without any weight there is nothing to learn, and large outputs do not overflow
    assert all(not np.any(x[1] if k == "E" else x) for k, x in model.gradients(read, target, np.zeros_like(weight)).items())
    model.p["c"] = model.p["c"] + np.float32(200) * np.arange(len(model.p["c"]), dtype=np.float32)
    assert all(np.isfinite(x[1] if k == "E" else x).all() for k, x in model.gradients(read, target, weight).items())


def plain_log_p(p, bounds, read, place):
    """ln P(every row) after the place of one window, in loops: what the batched code must give."""
    d = _attention.DIM
    m = (p["E"][read] + p["P"]) @ p["W"]
    q, k, v = m[:, :d], m[:, d : 2 * d], m[:, 2 * d :]
    s = np.array([q[place] @ k[j] / math.sqrt(d) for j in range(place + 1)])
    a = np.exp(s - s.max())
    o = sum(x * v[j] for j, x in enumerate(a / a.sum()))
    h = np.tanh(o @ p["O"] + v[place])
    soft = lambda z: z - z.max() - math.log(np.exp(z - z.max()).sum())
    kind, out = soft(h @ p["C"] + p["c"]), []
    for c in range(len(bounds) - 1):
        inside = slice(bounds[c], bounds[c + 1])
        out += list(kind[c] + soft(p["Out"][inside] @ h + p["b"][inside]))
    return np.array([*out, kind[-1]])


def test_windows_score_each_subword_once_and_sum_to_one():
    rng = np.random.default_rng(1)
    layout, model = small_net()
    window, step = _attention.WINDOW, _attention.STEP
    p = {k: x.astype(np.float64) for k, x in model.p.items()}
    for size in (1, 2, 15, 16, 17, 28, 29, 100):
        rows = rng.integers(0, 41, size)
        read = np.append(rows[-1], rows[:-1])
        want = []
        for i in range(size):
            # the window that scores place i: the first one, or the one whose last STEP places hold it
            k = 0 if i < window else 1 + (i - window) // step
            part = np.zeros(window, int)
            got = read[k * step : k * step + window]
            part[: len(got)] = got
            every = plain_log_p(p, layout.bounds, part, i - k * step)
            assert np.isclose(np.exp(every).sum(), 1)
            want.append(every[rows[i]])
        other = np.append(rng.integers(0, 41, 5), rows[-1])
        both = model.text_log_p(np.concatenate([other, rows]), np.array([0, 6, 6 + size]))
        assert np.allclose(both[6:], want, atol=2e-3)


def test_mixture_is_a_probability_over_words():
    """Next to every text so far, known words, and all spelled words together, have probability one."""
    rng = np.random.default_rng(3)
    key = np.arange(1, 7, dtype=np.uint64) << np.uint64(40)
    table = np.concatenate([rng.integers(0, 4, (6, 2)).astype(float), [[3.0, 2.0]]])  # the end last
    table = np.concatenate([table, table.sum(axis=1, keepdims=True)], axis=1)
    rare = np.array([4.0, 1.0, 5.0])  # tokens of words that were not sent
    counts = lm.Counts.of(key, table, table.sum(axis=0) + rare, (table > 0).sum(axis=0) + np.minimum(rare, 2))
    spell = rng.dirichlet(np.ones(9))  # of the six words, two others, and the end

    def log10_p(text):
        hashes = np.append(key, [np.uint64(91) << np.uint64(40), np.uint64(92) << np.uint64(40)])
        unit = np.array(text)
        t = lm.Tokens(np.zeros(len(unit), int), np.arange(len(unit)), np.array([0, len(unit)]), hashes, unit, np.array([0, len(unit)]))
        return lm.mixture(t, np.log(spell[unit]), counts, counts.rows_of(hashes))[0]

    for before in ([], [2], [2, 6, 2], [7, 7, 1]):
        total = sum(10 ** log10_p([*before, u]) for u in range(9))
        assert np.isclose(total, 10 ** log10_p(before) if before else 1.0, rtol=1e-4)


def test_scores_beat_the_base_on_most_unseen_texts(spark):
    got = op7_attention_scoring(spark, MEDIUM)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    for held in (True, False):
        rows = [r for r in got.collect() if r.held_out == held]
        assert sum(r.score for r in rows) > 0.98 * sum(r.base_score for r in rows)  # nearer to zero is better
        assert np.mean([r.score > r.base_score for r in rows]) > 0.5


def test_counts_and_steps_cover_all_training_texts(spark):
    docs = table(spark, SMALL, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = docs.collect()
    tokens = Counter(x for r in rows for x in words(lower(r.text)))
    topics = lm.topics_of(docs.select("text"))
    assert topics.shape[1] == lm.BUCKETS and 1 < len(topics) <= lm.TOPICS and np.allclose(np.exp(topics).sum(axis=1), 1, atol=1e-3)
    got = lm.counts_of(docs, topics).collect()
    by_word = Counter()
    for r in got:
        if r.kind < 1000:
            by_word[r.key] += r.n
    assert sorted(by_word.values()) == sorted(tokens.values())
    assert sum(r.n for r in got if r.kind >= 1000) == len(rows)

    (w,) = slices(pa.array([r.text for r in rows] + [None, "", " "]), True, max_bytes=1 << 30)
    every, opens, closes = lm.blocks(w, np.random.default_rng(0), 1.0)
    assert (every.starts == w.starts).all() and opens.sum() == closes.sum() == len(rows) + 3 and every.counts.max() <= lm.BLOCK_WORDS
    some = [lm.blocks(w, np.random.default_rng(k), 0.25)[0] for k in range(40)]
    assert len(np.unique(np.concatenate([x.starts for x in some]))) == len(w.starts)  # no place is left out for good

    raw = spark.sparkContext.broadcast(lm.vocabulary())
    ends = np.array([len(rows)], float)
    sent = spark.sparkContext.broadcast(lm.Counts.of(np.zeros(0, np.uint64), ends[None], ends, ends))
    begun = lm.start(docs.limit(40).select("text"), raw, sent, 8)
    refined, n = lm.refine(docs, raw, sent, begun, share=1.0)
    t = lm.Subwords.of(raw.value).tokens(w)
    assert 0.8 * len(t.ids) < n <= len(t.ids)  # the first word of a block inside a text is read, but not learnt
    assert refined.spell(t).sum() > begun.spell(t).sum()


def test_refine_reads_every_block_of_every_text(spark):
    """By default the pass takes steps on all blocks; it once drew one in 16."""
    docs = table(spark, SMALL, "documents").select(F.col("doc_id").alias("id"), "text").limit(30)
    raw = spark.sparkContext.broadcast(lm.vocabulary())
    ends = np.array([30.0])
    sent = spark.sparkContext.broadcast(lm.Counts.of(np.zeros(0, np.uint64), ends[None], ends, ends))
    begun = lm.start(docs.select("text"), raw, sent, 8)
    (w,) = slices(pa.array([r.text for r in docs.collect()]), True, max_bytes=1 << 30)
    assert 0.8 * len(lm.Subwords.of(raw.value).tokens(w).ids) < lm.refine(docs, raw, sent, begun)[1]


def test_topics_and_rows_of_subwords_come_from_all_texts(spark):
    """Both once came from at most ``start_texts`` texts, and subwords of all others shared one row."""
    docs = table(spark, SMALL, "documents").select(F.col("doc_id").alias("id"), "text")
    (w,) = slices(pa.array([r.text for r in docs.collect()]), True, max_bytes=1 << 30)
    raw = spark.sparkContext.broadcast(lm.vocabulary())
    t = lm.Subwords.of(raw.value).tokens(w)
    pieces = np.bincount(t.ids)
    speller = lm.fit(docs, raw, start_texts=5)[2]
    near = min(_attention.NEAR, np.count_nonzero(pieces))
    row = speller.layout.row[: len(pieces)]
    assert len(np.unique(row[row < near])) == near and pieces[row < near].min() >= pieces[row == near].max(initial=0)
    one = spark.sparkContext.broadcast(lm.Counts.of(np.zeros(0, np.uint64), np.ones((1, 1)), np.ones(1), np.ones(1)))
    assert lm.refine(docs, raw, one, speller)[1] == len(t.ids)  # the first words of blocks were not learnt
    topics = lm.topic_counts(docs, start_texts=5)
    assert 1 < len(topics) <= 5 and topics.sum() == len(w.starts)
    assert len(lm.topic_counts(docs.limit(0))) == 0 and not lm.topic_counts(docs.select(F.lit(" ").alias("text"))).any()


def test_topics_do_not_depend_on_the_split(spark):
    docs = table(spark, SMALL, "documents").select(F.col("doc_id").alias("id"), "text")
    one, many = (lm.topic_counts(docs.repartition(n)) for n in (1, 5))
    assert one.shape == many.shape and np.array_equal(one, many)


def test_parts_of_the_first_pass_hold_every_text_once(spark, monkeypatch):
    docs = table(spark, SMALL, "documents").select(F.col("doc_id").alias("id"), "text")
    passed = []
    monkeypatch.setattr(lm, "refine", lambda texts, raw, sent, speller, **_: (passed.append(sorted(r.id for r in texts.collect())), (speller, 0))[1])
    for size, more in ((1 << 40, 0), (1, lm.PASSES - 1)):
        passed.clear()
        lm.learn_all(docs, None, None, lm.Speller(None, None, size))
        every = sorted(r.id for r in docs.collect())
        assert sorted(sum(passed[: len(lm.PARTS)], [])) == every and passed[len(lm.PARTS) :] == [every] * more
    assert sum(share for share, *_ in lm.PARTS) == 1
