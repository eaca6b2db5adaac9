"""Search by descending quadtrees against scores of all documents in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from llm.helpers import SCHEMA, awkward, lower

from quillrisk.llm import _treap, ranked
from quillrisk.session import durable, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=20):
    terms = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in terms), sum(c.total() for _, c in terms)
    df, out = Counter(t for _, c in terms for t in c), []
    for item, text in items:
        query, scores = TERM.findall(lower(text)), []
        for place, (i, c) in enumerate(terms):
            if c:
                m = 75 + (25 * c.total() * n_docs) // total
                w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))  # noqa: B023, E731
                score = sum(w(t) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in query if t in c)
                if score:
                    scores.append((-score, i is None, i if i is not None else 0, place, i))
        out += [(item, r + 1, s[4], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def rows_of(found):
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_documents(spark):
    docs, items = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    indexed = durable(ranked.index(docs.repartition(3), block_bytes=1 << 15), "index")
    assert indexed.count() > 10
    assert rows_of(ranked.search(indexed, items)) == want
    assert rows_of(ranked.search(indexed, items, pass_bytes=2000)) == want
    assert rows_of(ranked.search(ranked.index(docs), items, k=3)) == [r for r in want if r[1] <= 3]


def test_ties_and_awkward_rows(spark):
    copies = ["the same brown words"] * 60 + ["Brown", "brown brown fox", "漢字 fox", "w " * 20000 + "fox"]
    docs = awkward(spark, copies).repartition(3)
    items = [(1, "brown"), (2, "The quick FOX, the fox"), (3, None), (4, ""), (5, "absent"), (6, "漢字 é"), (6, "x1 word"), (None, "fox w"), (7, "the")]
    asked = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for size in (200, 1 << 20):
        got = rows_of(ranked.search(durable(ranked.index(docs, block_bytes=size), "index"), asked))
        assert got == brute(rows, [i for i in items if i[0] != 6] + [i for i in items if i[0] == 6])


def test_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(f"d{i}", f"alpha beta{i % 3}") for i in range(40)] + [(None, "alpha only")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "alpha beta1 beta1")], "item_id string, text string")
    got = rows_of(ranked.search(ranked.index(docs), items))
    assert got == brute([tuple(r) for r in docs.collect()], [("q", "alpha beta1 beta1")]) and len(got) == 20
    none = spark.createDataFrame([], SCHEMA)
    assert ranked.index(none).count() == 0
    assert ranked.search(ranked.index(none), items).count() == 0
    assert ranked.search(ranked.index(docs), items.where("false")).count() == 0
    clash = docs.selectExpr("*", "1 AS n_docs", "2 AS ids", "3 AS id", "4 AS item")
    assert len(rows_of(ranked.search(ranked.index(clash), items.selectExpr("*", "5 AS item", "6 AS id", "7 AS terms")))) == 20


@pytest.mark.parametrize("seed", range(4))
def test_treap_holds_the_grid(seed):
    rng = np.random.default_rng(seed)
    side = [1, 3, 40, 5000][seed]
    places = np.unique(rng.integers(0, side * 7, 3000))
    rows, columns, values = places // 7, places % 7, rng.integers(1, 10**6, len(places))
    grid = _treap.Treap.load(*_treap.Treap.build(rows, columns, values))
    cell = np.zeros(len(rows), np.int64)
    for level in range(grid.height):
        assert all(grid.most[cell] >= values)
        shift = grid.height - 1 - level
        cell = grid.down(cell, 2 * (rows >> shift & 1) + (columns >> shift & 1))
        assert all(cell > 0)
    assert (grid.most[cell] == values).all() and grid.most[0] == values.max()


def test_few_states_are_halved():
    """One rare term in many documents: the best come first and the rest are never looked at."""
    n = 1 << 15
    values = np.random.default_rng(1).permutation(n) + 1
    grid = _treap.Treap.load(*_treap.Treap.build(np.zeros(n, np.int64), np.arange(n), values))
    tops = ranked.Tops(1, 20)
    halved = ranked.descend(grid, np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64), tops)
    assert list(tops.score) == list(range(n, n - 20, -1)) and halved < n / 40
