import hashlib
from collections import Counter
from random import Random

from conftest import SMALL
from llm.helpers import SCHEMA, awkward, words

from quillrisk.llm import substring
from quillrisk.llm.queries import op6_seed_extend_dedup
from quillrisk.session import table


def brute(rows, span=20):
    """rows: (id, text); a null id is the largest."""
    order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    seen, out = {}, {}
    for key in order:
        w = words(key[2])
        for p in range(len(w) - span + 1):
            seen.setdefault(tuple(w[p : p + span]), (key[:2], p))
    for key in order:
        w, gone = words(key[2]), set()
        for p in range(len(w) - span + 1):
            if seen[tuple(w[p : p + span])] < (key[:2], p):
                gone.update(range(p, p + span))
        out[key[1] if not key[0] else None] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    got = [(r.id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs).collect()]
    assert Counter(got) == Counter((i, *want[i]) for i, _ in rows)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, None, 0, 0, 0, "") for i, t in enumerate(texts)], SCHEMA)


def test_documents(spark):
    docs = table(spark, SMALL, "documents")
    check(docs)
    check(docs.repartition(7))
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for r in op6_seed_extend_dedup(spark, SMALL).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == (*want[r.doc_id][:2], hashlib.sha256(want[r.doc_id][2].encode()).hexdigest())


def test_planted_passages(spark):
    rng = Random(11)
    make = lambda n, k=400: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    passage, texts = make(60), []
    for i in range(60):
        cut = rng.randrange(0, 30)
        texts.append(f"{make(rng.randrange(0, 50))} {' '.join(passage.split()[cut:cut + rng.randrange(15, 40)])}\n{make(rng.randrange(0, 30))}")
    texts += [make(400, 2), make(300, 1), " ".join(["a", "b", "c"] * 60), passage + " " + passage, texts[3], texts[4]]
    check(frame(spark, texts))


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 64)
    rng = Random(2)
    check(frame(spark, [" ".join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(300))) for _ in range(20)]))


def test_awkward_rows(spark):
    check(awkward(spark, ["p " * 45, " ".join(map(str, range(50))), "z " + " ".join(map(str, range(50)))]))
    assert substring.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_anchors_that_collide_are_told_apart_by_their_words(spark):
    rng = Random(5)
    line = [f"w{rng.randrange(5000)}" for _ in range(600)]
    texts = [" ".join(line[a : a + rng.randrange(20, 90)] + [f"x{i}"] + line[b : b + 25]) for i, (a, b) in enumerate((rng.randrange(500), rng.randrange(500)) for _ in range(40))]
    docs = frame(spark, texts)
    want = brute(list(enumerate(texts)))
    rows = docs.selectExpr("doc_id AS id", "text")
    for bits in (64, 2, 0):
        covered = {}
        for r in substring.repeats(rows, anchor_bits=bits).collect():
            covered.setdefault(r.id, set()).update(range(r.first, r.first + r.length))
        assert {i: len(covered.get(i, ())) for i in want} == {i: w[1] for i, w in want.items()}


def test_a_common_passage_in_many_contexts(spark):
    """Its first place stands in a context that no other place shares, so most windows are compared among the others."""
    rng = Random(9)
    passage = [f"p{k}" for k in range(10)]
    sides = [[f"s{side}{k}" for k in range(14)] for side in range(3)]
    texts = []
    for i in range(60):
        left, right = (rng.choice(sides) for _ in range(2))
        texts.append(" ".join([f"a{i}", *(left if i else ["odd"] * 3), *passage, *(right if i else ["end"] * 3), f"b{i}"]))
    check(frame(spark, texts).repartition(5))
