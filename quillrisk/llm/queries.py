"""Registered queries of the numbered operators, with their production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrisk.llm import crosstok, decontam, langid, lm, mixing, pii, pivots, ranked, rules, sharding, simhash, substring, toxicity
from quillrisk.session import durable, table

SHARDS = 16
TOXIC = 0.7


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pieces = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(rows, pieces).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitise(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.startswith(kind + ":"))).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.filter("spans", lambda s: ~s.startswith("term:")), ",")
    return out.select(
        F.col("id").alias("doc_id"), *[count(k) for k in pii.KINDS], F.sha2(base, 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans")
    )


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")


def op5_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), langid.held_out("doc_id", 5, 0)
    found = langid.identify(docs, langid.fit(docs.where(~out), "doc_id", "text", "lang"))
    found = found.withColumnRenamed("id", "doc_id")
    return found.select("doc_id", out.alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


def op6_seed_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_attention_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.held_out("doc_id", 7, 2)
    found = lm.score(table(spark, sf_dir, "documents"), ~out).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pivots.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op9_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.balanced_shards(table(spark, sf_dir, "documents"), shards=SHARDS)
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), langid.held_out("doc_id", 3, 1)
    net = toxicity.fit(docs.where(~out), table(spark, sf_dir, "labels").where(~out), at=TOXIC)
    found = toxicity.score(docs, net).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op11_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(rules.ledger(table(spark, sf_dir, "documents")), "rule-ledger")
    base = ~rules.POLICIES[1].keeps(F.col("failed"))
    judged = rules.judge(rows, rules.POLICIES[2]).withColumnRenamed("id", "doc_id").withColumn("base_failed", base)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, _ = crosstok.alignments(table(spark, sf_dir, "documents"))
    return texts.withColumnRenamed("id", "doc_id")


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = durable(ranked.index(table(spark, sf_dir, "documents")), "treap-index")
    return ranked.search(indexed, table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_disclosure_pii,
        op3_spaced_seed_decontamination,
        op4_simhash_near_dedup,
        op5_centroid_language,
        op6_seed_extend_dedup,
        op7_attention_scoring,
        op8_pivot_near_dedup,
        op9_label_propagation_shards,
        op10_recurrent_toxicity,
        op11_rule_ledger,
        op12_token_alignment,
        op13_treap_search,
    )
}

#: The same mix without slots or blocks: a document's words that lie before the end of its source's last pass.
OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), named AS (
  SELECT source, sum(size) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS weight FROM named
), reached AS (
  SELECT *, source_size * 3.0::DOUBLE AS lim, source_size * 3.0::DOUBLE / weight AS reach FROM weighted
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level
  FROM reached WINDOW w AS (ORDER BY reach, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), plan AS (
  SELECT source, source_size,
    least(lim, coalesce((SELECT arg_min(level, reach) FROM levels WHERE reach > level) * weight, lim)) AS target FROM levels
), placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, CAST(floor(p.target) AS BIGINT) AS whole,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE (whole // source_size) * size + greatest(0, least(size, whole % source_size - begins)) END AS BIGINT) AS taken
FROM placed
"""

#: Windows unnested and counted; the policy written out.
OP11_SQL = r"""
WITH read AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), starts AS (
  SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS i FROM read WHERE len(words) > 2
), found AS (
  SELECT r, list(i) AS places FROM starts GROUP BY r, words[i], words[i + 1], words[i + 2] HAVING count(*) > 1
), covered AS (
  SELECT r, count(DISTINCT p + k) AS n FROM (SELECT r, unnest(places) AS p FROM found), (VALUES (0), (1), (2)) AS t(k) GROUP BY r
), measured AS (
  SELECT doc_id, length(text) AS n_chars, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM read LEFT JOIN covered USING (r)
), failures AS (
  SELECT *, CAST(CAST(n_words < 50 AS INT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS INT) + 4 * CAST(word_chars < 2 * n_words AS INT)
    + 8 * CAST(word_chars > 20 * n_words AS INT) + 16 * CAST(100 * n_symbols > 20 * word_chars AS INT) + 32 * CAST(100 * n_dup_lines > 70 * n_lines AS INT)
    + 64 * CAST(word_chars * 4 < n_chars AS INT) AS BIGINT) AS failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
  failed & 19 = 0 AND bit_count(failed & 108) <= 1 AS kept, failed FROM failures
"""

#: Every document that holds a term of an item is scored.
OP13_SQL = r"""
WITH abc AS (
  SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term
), read AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), term) AS terms FROM documents, abc
), sizes AS (
  SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms)) AS total FROM read
), held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM read) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, sizes GROUP BY term, docs
), wanted AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), up, low), term)) AS term FROM benchmark, abc
), scored AS (
  SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + CAST((25 * len(terms) * docs) // total AS BIGINT))))) AS BIGINT) AS score
  FROM wanted JOIN held USING (term) JOIN weights USING (term) JOIN read USING (r), sizes GROUP BY item_id, r
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored JOIN read USING (r) WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

ORACLE_SQL = {"op13_treap_search": OP13_SQL, "op1_mix_sources": OP1_SQL, "op11_rule_ledger": OP11_SQL}
