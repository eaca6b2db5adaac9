from collections import Counter

import corpus_pipeline
from conftest import MEDIUM, SMALL
from llm.helpers import SCHEMA, awkward, words
from llm.test_mixing import brute_targets
from llm.test_simhash import brute_classes, brute_fp

from quillrisk.llm import langid, toxicity
from quillrisk.session import table


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    out = langid.held_out("doc_id", 3, 1)
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, SMALL).cache()
    net = toxicity.fit(docs.where(~out), table(spark, SMALL, "labels").where(~out))
    rows = docs.collect()
    import pyarrow as pa

    score = net.scores(pa.array([r.text for r in rows]))
    assert ids(clean) == Counter(r.doc_id for r, s in zip(rows, score) if s < 0.7) and clean.columns == docs.columns

    one = stages["simhash_near_dedup"](spark, docs, SMALL)
    fps = [(r.doc_id, brute_fp(r.text)) for r in rows]
    classes = brute_classes(fps)
    assert ids(one) == Counter({classes[f] for _, f in fps}) and one.columns == docs.columns

    kept = ids(stages["decontamination"](spark, docs, SMALL))
    tests = [f" {' '.join(r.text.split())} " for r in table(spark, SMALL, "benchmark").collect()]
    assert kept == Counter(r.doc_id for r in rows if not any(t in f" {' '.join(r.text.split())} " for t in tests))

    mixed = stages["mixing"](spark, docs, SMALL)
    sizes, got = Counter(), Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    for r in mixed.collect():
        got[r.source] += len(words(r.text))
    longest = max(len(words(r.text)) for r in rows)
    assert all(abs(got[s] - t) <= longest for s, t in brute_targets(sizes).items()) and mixed.columns == docs.columns


def test_run(spark):
    got = corpus_pipeline.run(spark, MEDIUM).collect()
    known = ids(table(spark, MEDIUM, "documents"))
    counts = Counter(r.shard for r in got)
    assert got and {r.doc_id for r in got} <= set(known)
    assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1 and max(Counter(r.doc_id for r in got).values()) <= 3


def test_awkward_rows(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() > 0, name
        assert stage(spark, spark.createDataFrame([], SCHEMA), SMALL).count() == 0, name
    name, last = corpus_pipeline.STAGES[-1]
    assert ids(last(spark, docs, SMALL)) == ids(docs)
    assert last(spark, spark.createDataFrame([], SCHEMA), SMALL).count() == 0, name
