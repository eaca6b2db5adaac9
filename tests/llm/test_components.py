from random import Random

from quillrisk.llm.components import components


def brute(edges):
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def test_chains_stars_and_loops(spark):
    rng = Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (8, 9), (9, 8), (8, 9)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    df = spark.createDataFrame([*edges, (None, 4), (4, None)], "a long, b long")
    want = brute([e for e in edges if e[0] != e[1]])
    assert {r.node: r.root for r in components(df).collect()} == want


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
