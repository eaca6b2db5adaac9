"""The ledger against plain Python, policies and ablations against the ledger's rows taken one by one."""

from collections import Counter

import pytest
from conftest import MEDIUM
from llm.helpers import SCHEMA, awkward, words

from quillrisk.llm import rules
from quillrisk.session import durable, table


def brute(text):
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    m = {"n_chars": len(text), "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    m |= {"n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    failed = sum(1 << i for i, (_, when) in enumerate(rules.RULES) if eval(when, {}, m))
    return m | {"failed": failed}


TEXTS = ["a b c a b c", "a b c d", "x y x y x y", "a a a", "a a a a", "\n\nx\n x\nx\n\t\n", "漢 字 漢 字 漢 字 #", "p q r s p q r t p q", "word " * 20000, " ".join(f"w{i % 9973}" for i in range(20000))]


def check(docs):
    rows = rules.ledger(docs).collect()
    want = sorted((repr(r.doc_id), sorted(brute(r.text).items())) for r in docs.collect())
    assert sorted((repr(r.id), sorted({k: v for k, v in r.asDict().items() if k != "id"}.items())) for r in rows) == want
    return rows


def test_ledger(spark):
    check(table(spark, MEDIUM, "documents"))
    check(awkward(spark, TEXTS))
    assert rules.ledger(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_and_no_shuffle(spark):
    plan = rules.judge(rules.ledger(table(spark, MEDIUM, "documents")), rules.POLICIES[2])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_policies_and_ablations(spark):
    rows = durable(rules.ledger(table(spark, MEDIUM, "documents")), "ledger")
    bits = [(r.failed, r.n_words) for r in rows.collect()]

    def keeps(p, failed, without=0):
        hard, soft = p.hard_bits & ~without, p.soft_bits & ~without
        return not failed & hard and bin(failed & soft).count("1") <= p.allowed

    policies = [*rules.POLICIES.values(), rules.Policy("two", 9, (), tuple(rules.BIT), allowed=2)]
    got = {(r.version, r.rule): r for r in rules.ablate(rows, policies).collect()}
    for p in policies:
        judged = rules.judge(rows, p).groupBy("policy_version", "kept").count().collect()
        assert {(r.policy_version, r.kept): r["count"] for r in judged} == {(p.version, k): n for k, n in Counter(keeps(p, f) for f, _ in bits).items()}
        for rule, bit in rules.BIT.items():
            r = got[p.version, rule]
            assert r.n_failed == sum(f & bit != 0 for f, _ in bits) and r.n_kept == sum(keeps(p, f) for f, _ in bits)
            assert r.n_kept_without == sum(keeps(p, f, bit) for f, _ in bits)
            assert r.words_kept_without == sum(n for f, n in bits if keeps(p, f, bit))
    assert len(got) == len(policies) * len(rules.RULES)
    pairs = {(r.rule, r.other): r.n for r in rules.overlaps(rows).collect()}
    assert pairs == {(a, b): sum(f & x != 0 and f & y != 0 for f, _ in bits) for a, x in rules.BIT.items() for b, y in rules.BIT.items() if x < y}


def test_empty_ledger(spark):
    rows = rules.ledger(spark.createDataFrame([], SCHEMA))
    assert all(r.n_kept == r.n_failed == r.words_kept == 0 for r in rules.ablate(rows, [rules.POLICIES[2]]).collect())


@pytest.mark.parametrize("version", rules.POLICIES)
def test_bits_of_a_policy(version):
    p = rules.POLICIES[version]
    assert p.hard_bits & p.soft_bits == 0 and p.hard_bits & rules.POLICIES[1].hard_bits == 3
