"""Near-duplicate groups, blind samples and whole classification reports."""

import random

from pyspark.sql import functions as F

from quillrisk.functions import text as X
from quillrisk.operators import dedupe, evaluation, features


def by_union(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_groups(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(150)]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 2000 + i) for i in range(80)] + [(1000, 1001)]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = {r.id: r.member_of for r in dedupe.groups(spark.createDataFrame([*pairs, (7, 7), (None, 3)], "a long, b long")).collect()}
    assert got == by_union(pairs)
    assert not dedupe.groups(spark.createDataFrame([], "a long, b long")).collect()


def test_near_representatives(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, "copy", words) for i in range(5, 60)] + [(3, "near", [*words[:-1], "x"]), (2, "nearer", [*words[:-2], "x", "y"]), (9, "other", ["a", "b"]), (8, None, []), (7, None, [])]
    got = dedupe.near_representatives(spark.createDataFrame(rows, "doc_id long, key string, grams array<string>"), "doc_id", "key", "grams")
    assert sorted(r.doc_id for r in got.collect()) == [2, 7, 9]


def test_texts_are_read_once_for_representatives_and_sample(spark):
    """Keys and columns once were worked out over all texts again for every step: eight times in all."""
    worked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def plain(text):
        worked.add(1)
        return text.lower()

    rng = random.Random(2)
    rows = [(i, f"{i % 5}", "s", "m", " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(300)]
    rows += [(1000 + i, "5", "s", "m", f"{rows[i][4]} again".upper()) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, tag string, source string, month string, text string").withColumn("plain", plain("text")).withColumn("wide", F.contains("plain", F.lit("w1")))
    one = dedupe.near_representatives(df, "doc_id", F.sha1("plain"), X.word_hashes(F.col("plain")), columns=("source", "month", "tag", "wide"), of=X.word_runs)
    picked = features.blind_sample(one, "doc_id", ["tag", "wide"], "source", "month", 5, {"s": 200}).collect()
    assert len(picked) == 200 and all(r.doc_id < 1000 for r in picked)
    assert worked.value <= 3 * len(rows)  # keys and tokens: once or twice each, and again for those with a partner


def test_ids_of_several_texts_and_large_classes_of_equal_sets(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, "k1", ["a", "b"]), (1, "k2", words), (2, "k2", words), (3, "k3", ["a", "b", "c", "d"]), (2, "k1", ["a", "b"])]
    rows += [(100 + i, f"k{100 + i}", words[::-1]) for i in range(300)]  # equal sets under keys of their own: linked with the first, not with one another
    table = spark.createDataFrame(rows, "doc_id long, key string, grams array<string>")
    got = dedupe.near_representatives(table, "doc_id", "key", "grams", columns=("key",))
    assert sorted((r.doc_id, r.key) for r in got.collect()) == [(1, "k1"), (1, "k2"), (3, "k3")]


def test_plain_forms_equal_those_by_replacing(spark):
    rng = random.Random(8)
    parts = ["the", "The", "THE_", "rt", " RT ", "@me", "https://x.y/z?the", "www.a.b", "$5", "50%", "é", "İ", "ß", "\u212a", "\u2028", "\U0001f600", "\n", "\t", " ", "-", "the-end", "bathe", "_", "'", "x\x00y"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(8))) for _ in range(400)] + [None, "", " ", "the"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), X.URL, " ")
    out = F.regexp_replace(F.regexp_replace(out, r"@\w+", " "), r"^\s*rt\b", " ")
    key = F.trim(F.regexp_replace(out, "[^0-9a-z$%]+", " "))
    wide = F.contains(X.normal_phrase(F.col("text")), F.lit(" the "))
    for r in df.select("text", key.alias("a"), X.normal_key(F.col("text")).alias("b"), wide.alias("c"), X.has_word(F.col("text"), "the").alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d), r


def test_blind_sample_keeps_quotas(spark):
    rows = [(i, f"c{i % 11 % 4}", "rare" if i % 97 == 0 else "usual", "news" if i % 3 else "social", f"m{i % 10 // 4}") for i in range(600)]
    rows.append((9000, None, "usual", None, None))
    df = spark.createDataFrame(rows, "doc_id long, kw string, model string, src string, month string")
    out = [r for r in features.blind_sample(df, "doc_id", ["kw", "model"], "src", "month", 5, {"news": 60, "social": 33}).collect()]
    picked = {r.doc_id for r in out}
    assert len(picked) == len(out) and sorted(r.item for r in out) == [f"H{i:04d}" for i in range(1, len(out) + 1)]
    per = {s: [r for r in out if r.source == s] for s in ("news", "social", None)}
    assert len(per["news"]) == 60 and len(per["social"]) == 33 and [r.doc_id for r in per[None]] == [9000]
    for at, classes in ((1, {"c0", "c1", "c2", "c3"}), (2, {"rare", "usual"})):
        for c in classes:
            assert sum(1 for r in rows if r[0] in picked and r[at] == c) >= 5
    fills = [r for r in out if r.reason.startswith("fill:news:m")]
    share = {m: sum(1 for r in fills if r.month == m) for m in ("m0", "m1", "m2")}
    assert share["m0"] > share["m2"] and abs(share["m0"] - share["m1"]) <= 1
    assert [r.doc_id for r in sorted(out, key=lambda r: r.item)] != sorted(picked)
    assert not features.blind_sample(df.limit(0), "doc_id", ["kw", "model"], "src", "month", 5, {"news": 60}).collect()


def test_whole_report(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] * 2 + [("b", "b")] + [(None, "a"), ("b", None), ("z", "a")]
    df = spark.createDataFrame(pairs, "g string, p string")
    cells = {(r.gold, r.predicted): r.n for r in evaluation.confusion_matrix(df, "g", "p", ["a", "b", "c"]).collect()}
    assert len(cells) == 9 and cells["a", "a"] == 3 and cells["a", "b"] == 2 and cells["b", "b"] == 1 and sum(cells.values()) == 6
    r = evaluation.overall(df, "g", "p", ["a", "b", "c"]).first()
    f1 = [2 * 3 / (2 * 3 + 2 + 2), 2 * 1 / (2 * 1 + 2 + 1), 0.0]
    assert r.n == 9 and abs(r.accuracy - 4 / 9) < 1e-12 and abs(r.macro_f1 - sum(f1) / 3) < 1e-12
    r = evaluation.overall(df.limit(0), "g", "p", ["a"]).first()
    assert (r.n, r.accuracy, r.macro_f1) == (0, 0.0, 0.0)
