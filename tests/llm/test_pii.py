import hashlib
import math
import re
from collections import Counter
from random import Random

from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.helpers import SCHEMA, awkward

from quillrisk.llm import pii
from quillrisk.llm.queries import op2_disclosure_pii
from quillrisk.session import table

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            good = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(d) <= 19 and luhn(d), 8 <= len(d) <= 15)[k]
            if good:
                out.append((k, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1.@+- (0)9é\n%_", max_size=60))
def test_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_spans_by_example():
    text = "mail a.b@c.de, 10.0.0.256 1.2.3.4.5.6.7.8 call +49 (30) 123-4567 card 4111 1111 1111 1111 x@y z@.com"
    assert pii.base_spans(text) == brute(text)
    assert len(pii.base_spans("1" * 200_000 + "." + "a" * 200_000 + "@")) == 0


def check(docs, spark):
    got = {}
    for r in pii.sanitise(docs).collect():
        got.setdefault(r.id, []).append(r)
    for r in docs.collect():
        want = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in brute(r.text or "")]
        for g in got[r.doc_id]:
            assert [s for s in g.spans if not s.startswith("term:")] == want
            assert g.clean == r.text or g.spans or r.text is None


def test_documents_and_awkward_rows(spark):
    check(table(spark, SMALL, "documents"), spark)
    check(awkward(spark, ["mail é x@y.zz now", "@", "+1234567890123456"]), spark)
    assert pii.sanitise(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digest(spark):
    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    for r in op2_disclosure_pii(spark, SMALL).collect():
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in brute(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_email, r.n_phone) == (base.count("email:"), base.count("phone:"))


def test_disclosing_terms_are_generalised_or_removed(spark):
    rng = Random(5)
    filler = lambda: " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(30))
    texts = [f"{filler()} the Zorblax office é of ann@x.org {filler()}" for _ in range(6)]
    texts += [f"{filler()} zorblax alone {filler()}", *[filler() + " the office of" for _ in range(200)]]
    docs = spark.createDataFrame([(i, t, None, None, 0, 0, 0, "") for i, t in enumerate(texts)], SCHEMA)
    for limit in (1 << 20, 0):  # sent to every task, and joined
        out = {r.id: r for r in pii.sanitise(docs, max_sent_terms=limit, remove_share=0.99).collect()}
        terms = lambda i: [texts[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in out[i].spans) if k == "term"]
        assert terms(0) == ["Zorblax", "é"] and terms(6) == ["zorblax"] and terms(10) == []
        assert "[EMAIL]" in out[0].clean and "Zorblax" not in out[0].clean and "[TERM] alone" in out[6].clean
        assert "é" not in out[0].clean and out[10].clean == texts[10]


def brute_terms(texts, window=8, min_together=3, min_share=0.5, min_bits=4.0):
    """Share and bits of every term, by counting documents in plain loops."""
    together, entity_docs, term_docs = Counter(), Counter(), Counter()
    for text in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", low)]
        spans = brute(text)
        term_docs.update({w for _, _, w in words})
        taken = [any(a < e and b > s for _, s, e in spans) for a, b, _ in words]
        near, own = set(), set()
        for k, s, e in spans:
            entity = (k, text[s:e])
            own.add(entity)
            before = [i for i, (a, b, _) in enumerate(words) if b <= s]
            after = [i for i, (a, b, _) in enumerate(words) if a >= e]
            reach = range(max(0, len(before) - window), min(len(words), len(words) - len(after) + window))
            near |= {(entity, words[i][2]) for i in reach if not taken[i]}
        together.update(near)
        entity_docs.update(own)
    out = {}
    for (entity, term), n in together.items():
        share = n / term_docs[term]
        bits = math.log2(share * len(texts) / entity_docs[entity])
        if n >= min_together and share >= min_share and bits >= min_bits:
            old = out.get(term, (0, 0))
            out[term] = max(share, old[0]), max(bits, old[1])
    return out


def test_terms_against_plain_counts(spark):
    rng = Random(7)
    people = [("ann@x.org", ["zorblax", "quint"]), ("10.0.0.7", ["hexa", "the"]), ("+49 30 1234567", ["Velm", "quint"])]
    texts = []
    for i in range(400):
        words = [rng.choice(["the", "of", "aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(rng.randrange(3, 40))]
        if i % 5 == 0:
            value, hints = rng.choice(people)
            at = rng.randrange(len(words))
            words[at:at] = [*(h for h in hints if rng.random() < 0.8), value, *(rng.choice(hints) for _ in range(2))]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for bits, found in ((4.0, {"hexa", "velm"}), (3.0, {"hexa", "velm", "zorblax"})):
        got = sorted((round(r.share, 9), round(r.bits, 9)) for r in pii.disclosing_terms(docs, min_bits=bits).collect())
        want = brute_terms(texts, min_bits=bits)
        assert got == sorted((round(s, 9), round(b, 9)) for s, b in want.values()) and found <= set(want)
