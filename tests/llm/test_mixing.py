from collections import defaultdict

import pytest
from conftest import MEDIUM
from llm.helpers import SCHEMA, awkward, words

from quillrisk.llm import mixing
from quillrisk.session import table


def brute_targets(sizes, cycle=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: cycle[i % 3] for i, s in enumerate(names)}
    total, out = sum(sizes.values()), {}
    free = set(names)
    while free:
        left, share = total - sum(out.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / share > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / share for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


def check(docs, **args):
    sizes = defaultdict(int)
    for r in docs.select("source", "text").collect():
        sizes[r.source] += len(words(r.text))
    want = brute_targets(sizes)
    rows, pieces = mixing.mix(docs, **args)
    got, taken = mixing.taken_words(rows, pieces).collect(), defaultdict(int)
    assert len(got) == docs.count()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-6) or abs(taken[s] - want[s]) <= 1 for s in sizes)
    return pieces


def test_documents_and_schedule(spark):
    pieces = check(table(spark, MEDIUM, "documents"), block_words=64)
    # Low discrepancy: any stretch of the schedule has nearly its share of each source.
    slots = pieces.selectExpr("slot", "substring_index(row, ':', 1) AS s").distinct().collect()
    n = len({r.slot for r in slots})
    total, early = defaultdict(int), defaultdict(int)
    for r in slots:
        total[r.s] += 1
        early[r.s] += r.slot < n // 3
    assert all(abs(early[s] - total[s] / 3) <= 6 for s in total)


def test_limits_are_reshared(spark):
    rows = [(i, "w " * (1000 if s == "a" else 20), None, s, 0, 0, 0, "") for i, s in enumerate(["a", "a", "b", "c", None])]
    check(spark.createDataFrame(rows, SCHEMA), block_words=7)


def test_awkward_rows(spark):
    check(awkward(spark))
    rows, pieces = mixing.mix(spark.createDataFrame([], SCHEMA))
    assert mixing.taken_words(rows, pieces).count() == 0
    rows, pieces = mixing.mix(spark.createDataFrame([(1, None, None, None, 0, 0, 0, ""), (2, " ", None, "s", 0, 0, 0, "")], SCHEMA))
    assert [r.taken for r in mixing.taken_words(rows, pieces).collect()] == [0, 0]
