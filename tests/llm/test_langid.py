import math
import zlib
from collections import Counter

import numpy as np
from conftest import MEDIUM
from llm.helpers import SCHEMA, awkward

from quillrisk.llm import langid
from quillrisk.llm.queries import op5_centroid_language
from quillrisk.session import table


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in table(spark, MEDIUM, "documents").collect()}
    rows = op5_centroid_language(spark, MEDIUM).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in held]) >= 0.97
    assert np.mean([r.rejected for r in held]) <= 0.05 and all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows(spark):
    docs = awkward(spark, ["123 %%% 456", "漢字漢字", "zzz qqq xxx"])
    model = langid.fit(docs, "doc_id", "text", "lang")
    out = langid.identify(docs, model).collect()
    assert len(out) == docs.count() and set(r.nearest for r in out) <= {"en", "und"}
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        none = not any(c.isalpha() for c in text[r.id] or "")
        assert (r.nearest == "und") == none and (r.score == 0 if none else True)
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty, langid.fit(empty, "doc_id", "text", "lang")).count() == 0
    assert {r.nearest for r in langid.identify(docs, langid.fit(empty, "doc_id", "text", "lang")).collect()} == {"und"}


def test_far_texts_are_rejected(spark):
    texts = [(i, " ".join(["lorem", "ipsum", "dolor"][(i + j) % 3] for j in range(30)), "la", None, 0, 0, 0, "") for i in range(20)]
    docs = spark.createDataFrame([*texts, (99, "xyz wvu tsr " * 9, None, None, 0, 0, 0, "")], SCHEMA)
    out = {r.id: r for r in langid.identify(docs, langid.fit(docs, "doc_id", "text", "lang")).collect()}
    assert out[99].lang == "und" and out[99].nearest == "la" and out[3].lang == "la"


def plain_code(a, b, c):
    """The bucket of three folded bytes."""
    m = 2**32 - 1
    x = ((a * 0x9E3779B1 + b * 0x85EBCA77) & m) ^ (c * 0xC2B2AE3D & m)
    return (x * 0x27D4EB2F & m) >> 20


def plain_counts(text):
    """Trigrams of lower-cased bytes, letters alone; other ASCII is one kind of break."""
    line = [b if b > 127 or 97 <= b <= 122 else 32 for b in text.lower().encode()]
    out = Counter()
    for a, b, c in zip(line, line[1:], line[2:]):
        if b != 32 or (a != 32 and c != 32):
            out[plain_code(a, b, c)] += 1
    return out


def test_predictions_against_plain_cosines(spark):
    docs = table(spark, MEDIUM, "documents").limit(150)
    model = langid.fit(docs, "doc_id", "text", "lang", docs_per_lang=30)
    got = {r.id: r for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        weights = {k: math.sqrt(n) * float(model.idf[k]) for k, n in plain_counts(r.text).items()}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        near = [sum(w * float(v[k]) for k, w in weights.items()) / norm for v in model.vectors]
        best = max(range(len(near)), key=near.__getitem__)
        g = got[r.doc_id]
        assert abs(g.score - near[best]) < 1e-4
        assert g.nearest == model.langs[best] or sorted(near)[-1] - sorted(near)[-2] < 1e-4
        assert g.rejected == (near[best] < float(model.reach[best])) or abs(near[best] - float(model.reach[best])) < 1e-4
