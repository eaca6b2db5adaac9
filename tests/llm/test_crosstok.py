"""Alignment by matrix products against whole texts encoded at once and compared byte by byte."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
from conftest import MEDIUM
from llm.helpers import SCHEMA, awkward

from quillrisk.llm import crosstok
from quillrisk.llm._incidence import Csr
from quillrisk.session import table

WORDS = ["the", "naïve", "漢字かな", "don't", "x" * 50, "été", "à", "a b", "…", "<|endoftext|>", "</s>", "<0x41>", "😀😀", "1234567", "\ttab", "re-do", "ﬁ", "Ωmega", "　", "\n"]


def tools():
    return crosstok.tokenizers(*crosstok.PATHS)


def spans(ids, side):
    """(id, start, end) of the tokens, and their bytes."""
    out, at, data = [], 0, b""
    for i in ids:
        piece = bytes(side.data[side.first[i] : side.first[i + 1]])
        out.append((i, at, at + len(piece)))
        at, data = at + len(piece), data + piece
    return out, data


def brute(texts):
    t, rows, linked = tools(), [], []
    for text in texts:
        a, b = t.a.encode(" " + (text or ""), add_special_tokens=False).ids, t.b.encode(text or "")
        (sa, ba), (sb, bb) = spans(a, t.sides[0]), spans(b, t.sides[1])
        if not text or ba != bb or ba != (" " + text).encode():
            rows.append((0, 0, 0, []))
            linked.append(Counter())
            continue
        links, j = Counter(), 0
        for i, lo, hi in sa:
            while sb[j][2] <= lo:
                j += 1
            k = j
            while k < len(sb) and sb[k][1] < hi:
                links[i, sb[k][0]] += 1
                k += 1
        cuts = sorted({e for *_, e in sa} & {e for *_, e in sb})
        groups = [[[], []] for _ in cuts]
        for k, s in enumerate((sa, sb)):
            for i, _, hi in s:
                groups[bisect_left(cuts, hi)][k].append(i)
        rows.append((len(a), len(b), len(groups), groups))
        linked.append(links)
    docs = Counter(p for c in linked for p in c)
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for (n_a, n_b, n_groups, groups), links in zip(rows, linked):
        name = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        best = sum(n for p, n in links.items() if docs[p] == most[p[0]])
        shared = sum(len(x) * len(y) for x, y in groups)
        total = sum(n * docs[p] for p, n in links.items())
        out.append((n_a, n_b, n_groups, links.total(), shared, best, total, hashlib.sha256(name.encode()).hexdigest() if groups else ""))
    return out, {(a, b, n, n == most[a]) for (a, b), n in docs.items()}


def check(docs, **args):
    rows = docs.collect()
    want, pairs = brute([r.text for r in rows])
    texts, found = crosstok.alignments(docs, **args)
    got = sorted((repr(r.id), *r[1:]) for r in texts.select("id", "n_a", "n_b", "n_groups", "n_links", "n_shared_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == sorted((repr(r.doc_id), *w) for r, w in zip(rows, want))
    assert {tuple(r) for r in found.select("a", "b", "docs", "best").collect()} == pairs
    return got


def test_documents(spark):
    check(table(spark, MEDIUM, "documents"), block_bytes=1 << 18)


def test_awkward_texts(spark):
    rng = random.Random(3)
    mixed = ["".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "", "\n ", " \n"]) for _ in range(30)) for _ in range(300)]
    odd = ["a▁b", "▁", " ", "  ", " lead", "trail ", " ", "a   b", "a  b", "\x1c x", "nul \0 byte", "<|endoftext|> </s> <s> <unk>", "word " * 20000]
    got = check(awkward(spark, odd + mixed), block_bytes=3000)
    assert sum(r[1] == 0 for r in got) >= 4 and sum(r[1] > 0 for r in got) > 250


def test_empty_table_and_text_ids(spark):
    texts, pairs = crosstok.alignments(spark.createDataFrame([], SCHEMA))
    assert texts.count() == 0 and pairs.count() == 0
    docs = spark.createDataFrame([("x", "some text"), ("x", "some text"), (None, None)], "id string, text string")
    texts, _ = crosstok.alignments(docs, "id")
    assert sorted((repr(r.id), r.n_a) for r in texts.collect()) == [("'x'", 2), ("'x'", 2), ("None", 0)]


def test_words_are_cut_where_both_tokenizers_are(spark):
    assert tools().by_words
    data = " a b  c\n d é e  f".encode() + b" g"
    starts = crosstok.word_starts(np.frombuffer(data, np.uint8), np.array([0, len(data) - 2, len(data)]))
    assert [data[s:e].decode() for s, e in zip(starts, [*starts[1:], None])] == [" a", " b  c\n d", " é", " e  f", " g"]


@pytest.mark.parametrize("seed", range(3))
def test_products(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 3, (7, 11)), rng.integers(0, 2, (11, 5))

    def sparse(m):
        rows, columns = np.nonzero(m)
        return Csr(np.searchsorted(rows, np.arange(len(m) + 1)), columns, m[rows, columns], m.shape[1])

    out = sparse(a).product(sparse(b.T).transpose())
    dense = np.zeros((7, 5), int)
    dense[out.rows, out.columns] = out.values
    assert (dense == a @ b).all() and (out.values > 0).all()
