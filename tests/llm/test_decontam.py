from itertools import product
from random import Random

import numpy as np
from conftest import SMALL
from llm.helpers import SCHEMA, awkward

from quillrisk.llm import decontam
from quillrisk.session import table


def items(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "item_id long, text string, row string")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, None, 0, 0, 0, "") for i, t in enumerate(texts)], SCHEMA)


def test_documents_that_hold_whole_items(spark):
    docs, bench = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    want = {}
    for b in bench.collect():
        for d in docs.collect():
            if f" {' '.join(b.text.split())} " in f" {' '.join(d.text.split())} ":
                want.setdefault(d.doc_id, set()).add(b.item_id)
    got = {r.id: set(r["items"]) for r in decontam.contamination(docs, bench).collect() if r.contaminated}
    assert want and all(want[i] <= got.get(i, set()) for i in want)
    assert set(got) == set(want)


def test_changed_words_are_tolerated(spark):
    rng = Random(4)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    tests = [make(30) for _ in range(12)] + [make(7), make(3)]
    docs, want = [], []
    for k, t in enumerate(tests):
        changed = list(t)
        for p in range(rng.randrange(8), len(t), 8) if len(t) > 8 else ():
            changed[p] = "changed"
        docs.append(" ".join([*make(40), *changed, *make(40)]))
        want.append(len(t) >= 5)  # an item of three words is no quotation
    docs += [" ".join(make(80)), " ".join([*make(20), *tests[0][:9], *make(20)]), " ".join(tests[1]).upper().replace(" ", ", ")]
    want += [False, False, True]
    got = {r.id: r for r in decontam.contamination(frame(spark, docs), items(spark, [" ".join(t) for t in tests])).collect()}
    assert [got[i].contaminated for i in range(len(docs))] == want
    assert got[0]["items"] == [0] and got[0].longest >= 24


def test_awkward_rows(spark):
    docs = awkward(spark)
    bench = items(spark, [None, "", "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dog", "one"])
    got = [(r.id, r.contaminated, r["items"]) for r in decontam.contamination(docs, bench).collect()]
    assert len(got) == docs.count()
    assert {i: x for i, c, x in got if c} == {3: [4], 5: [2], 6: [2]}
    assert not any(r.contaminated for r in decontam.contamination(docs, items(spark, [])).collect())
    assert decontam.contamination(spark.createDataFrame([], SCHEMA), bench).count() == 0


def rule(same):
    """Whether an item whose words are equal or not like this is contamination: brute force over all stretches."""
    n = len(same)
    best = max((sum(1 if s else -2 for s in same[a:b]), -a, -b) for a in range(n) for b in range(a, n + 1))
    return sum(same[-best[1] : -best[2]]) >= 13 or sum(same) >= 0.8 * n


def test_masks_meet_every_overlap_that_the_rule_accepts():
    rng = Random(5)
    lines = [c for n in range(5, 15) for c in product((True, False), repeat=n)]
    lines += [[rng.random() > share for _ in range(rng.randrange(15, 41))] for share in (0.1, 0.2, 0.3, 0.4) for _ in range(2000)]
    for same in lines:
        hit = any(all(same[i + p] for p in m) for m in decontam._masks() for i in range(len(same) - m[-1]))
        assert hit or not (sum(same) >= 0.8 * len(same) or decontam._best_stretch(np.array(same))[2] >= 13), same


def test_items_of_few_words_are_whole_documents(spark):
    texts = ["Yes.", "yes no", "no yes", "yes no maybe", "so yes", None, "", "yes no maybe so", "yes no maybe so then"]
    docs, bench = frame(spark, texts), items(spark, ["yes", "YES, no", "yes no maybe so", "?"])
    got = {r.id: r["items"] for r in decontam.contamination(docs, bench).collect()}
    assert got == {0: [0], 1: [1], 2: [], 3: [], 4: [], 5: [], 6: [], 7: [2], 8: []}


def test_recall_for_all_item_lengths_and_changes(spark):
    rng = Random(6)
    make = lambda n: [f"w{rng.randrange(50000)}" for _ in range(n)]
    tests = [make(n) for n in range(5, 61)]
    docs, want = [], []
    for k, t in enumerate(tests):
        for share in (0, 0.05, 0.1, 0.2, 0.2, 0.2, 0.35, 0.5):
            places = set(rng.sample(range(len(t)), int(len(t) * share)))
            docs.append(" ".join([*make(30), *(f"changed{p}" if p in places else w for p, w in enumerate(t)), *make(30)]))
            want.append([k] if rule([p not in places for p in range(len(t))]) else [])
    got = {r.id: r["items"] for r in decontam.contamination(frame(spark, docs), items(spark, [" ".join(t) for t in tests])).collect()}
    assert [got[i] for i in range(len(docs))] == want and 0 < sum(map(len, want)) < len(want)
