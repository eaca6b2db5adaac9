from collections import Counter, defaultdict
from random import Random

import numpy as np
import xxhash
from conftest import SMALL
from llm.helpers import SCHEMA, awkward, lower, words

from quillrisk.llm import simhash
from quillrisk.llm.queries import op4_simhash_near_dedup
from quillrisk.session import table


def brute_fp(text, k=4):
    w = words(lower(text))
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(rows, radius=4):
    """rows: (id, fp)"""
    fps = sorted({f for _, f in rows})
    near = {f: [g for g in fps if bin(f ^ g).count("1") <= radius] for f in fps}
    ids = defaultdict(list)
    for i, f in rows:
        ids[f].append(i)
    out, seen = {}, set()
    for f in fps:
        if f in seen:
            continue
        todo, group = [f], {f}
        while todo:
            for g in near[todo.pop()]:
                if g not in group:
                    group.add(g)
                    todo.append(g)
        seen |= group
        least = min((i for g in group for i in ids[g] if i is not None), default=None)
        out |= {g: least for g in group}
    return out


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = [(i, brute_fp(t)) for i, t in rows]
    classes = brute_classes(want)
    got = [(r.id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert Counter(got) == Counter((i, f, classes[f]) for i, f in want)


def test_documents_against_all_pairs(spark):
    check(table(spark, SMALL, "documents"))


def test_awkward_rows(spark):
    check(awkward(spark))
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_reach_all_pairs_within_radius(spark):
    rng = Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for flips in (1, 2, 3, 4, 4, 5, 6):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), flips)))
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    want = brute_classes(rows)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for _, f in rows], "fp long")
    for part in (2_000_000, 3_000):
        from quillrisk.llm.components import components

        roots = {r.node % 2**64: r.root for r in components(simhash.ball_links(df, 4, part)).collect()}
        groups = defaultdict(set)
        for f in fps:
            groups[roots.get(f, int(np.uint64(f).astype(np.int64)))].add(f)
        expected = defaultdict(set)
        for f in fps:
            expected[want[f]].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_query_columns(spark):
    out = op4_simhash_near_dedup(spark, SMALL)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert all(len(r.fingerprint) == 16 for r in out.limit(5).collect())
