import zlib
from collections import Counter, defaultdict

from conftest import MEDIUM
from llm.helpers import SCHEMA, awkward

from quillrisk.llm import sharding
from quillrisk.session import table


def law_holds(docs, shards=16):
    rows = docs.select("doc_id", "text").collect()
    got = sharding.balanced_shards(docs, shards=shards).collect()
    facts = lambda i, t: (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == Counter(facts(r.doc_id, r.text) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def test_documents(spark):
    got = law_holds(table(spark, MEDIUM, "documents"))
    shards = defaultdict(list)
    for r in got:
        shards[r.text_crc32].append(r.shard)
    copies = [s for s in shards.values() if len(s) > 1]
    apart = sum(len(s) - max(Counter(s).values()) for s in copies)
    assert apart <= 0.1 * sum(map(len, copies))


def test_one_text_holds_a_third(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i // 2}", None, None, 0, 0, 0, "") for i in range(3000)]
    got = law_holds(spark.createDataFrame(rows, SCHEMA))
    pairs = defaultdict(set)
    for r in got:
        pairs[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in pairs.values()) <= 0.1 * len(pairs)


def test_awkward_rows(spark):
    law_holds(awkward(spark), 4)
    assert sharding.balanced_shards(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reruns_agree(spark):
    docs = table(spark, MEDIUM, "documents")
    one, two = (Counter((r.id, r.shard, r.slot) for r in sharding.balanced_shards(docs.repartition(n)).collect()) for n in (3, 7))
    assert one == two
