"""Quality rules as a ledger of bits: rules are evaluated once, policies are applied to the bits afterwards.

``ledger`` measures every text and sets bit ``i`` of ``failed`` where rule ``i`` of ``RULES`` fails. ``judge`` applies a
versioned policy to the bits and ``ablate`` says what each of its rules does, from one row for each pattern of bits; neither reads a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Measurements of a text, all longs.
MEASURES = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: ``(name, when it fails)`` over the measurements; a rule's place is its bit. Add rules at the end, so that stored ledgers stay readable.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("many_symbols", "100 * n_symbols > 20 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 70 * n_lines"),
    ("mostly_blank", "word_chars * 4 < n_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """Texts stay that fail no rule of ``hard`` and at most ``allowed`` of ``soft``."""

    name: str
    version: int
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    allowed: int = 0

    @property
    def hard_bits(self) -> int:
        return sum(BIT[n] for n in self.hard)

    @property
    def soft_bits(self) -> int:
        return sum(BIT[n] for n in self.soft)

    def keeps(self, failed: Column, without: str | None = None) -> Column:
        """Whether it keeps a text that failed these rules, itself or less the rule ``without``."""
        left = ~BIT[without] if without else -1
        hard, soft = F.lit(self.hard_bits & left), F.lit(self.soft_bits & left)
        return (failed.bitwiseAND(hard) == 0) & (F.bit_count(failed.bitwiseAND(soft)) <= self.allowed)


BASE = ("few_words", "repeated_words")
POLICIES = {
    1: Policy("base", 1, BASE),
    2: Policy("balanced", 2, (*BASE, "many_symbols"), ("short_words", "long_words", "repeated_lines", "mostly_blank"), allowed=1),
    3: Policy("strict", 3, tuple(BIT)),
}


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more among ``words``, the first one included.

    Windows are sorted with their places; equal ones are neighbours. The places of repeated windows, in order, cover three words
    each, less where the next begins earlier.
    """
    at = lambda i: F.get(words, i)
    # The words follow the hash, so that only windows of one hash are compared by their words.
    window = lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), at(i).alias("a"), at(i + 1).alias("b"), at(i + 2).alias("c"), i.alias("i"))
    ordered = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))
    return F.aggregate(F.array(ordered), F.lit(0).cast("long"), lambda total, all_: total + _covered(all_))  # sorted once, whatever reads it


def _covered(ordered: Column) -> Column:
    same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    twice = lambda x, k: F.coalesce(same(x, F.get(ordered, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(ordered, k + 1)), F.lit(False))
    places = F.sort_array(F.transform(F.filter(ordered, twice), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, start, step, lambda s: s["n"])


def measure(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``texts`` with the columns of ``MEASURES`` (they replace columns of these names). A null text is empty.

    Only whole rows are read; no step needs another row, so nothing is shuffled.
    """
    kept = [c for c in texts.columns if c not in MEASURES]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = texts.select(*kept, F.struct(text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), F.split(text, "\n").alias("lines")).alias("_read"))
    text, words = F.col("_read.text"), F.col("_read.words")
    lines = F.filter(F.col("_read.lines"), lambda x: (x != "") & (F.trim(x, F.lit(BLANKS)) != ""))
    distinct = F.transform(F.array(words), lambda w: F.size(F.array_distinct(_hashes(w))))
    repeats = F.when(F.size(words) < 4, F.lit(0)).when(F.get(distinct, F.lit(0)) == F.size(words) - 2, F.lit(0)).otherwise(repeated_words(words))
    out = out.select(
        *kept,
        F.length(text).alias("n_chars"),
        F.size(words).alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        lines.alias("_lines"),
        repeats.alias("n_repeat_words"),
    )
    counted = {"n_lines": F.size("_lines"), "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines"))}
    return out.select(*kept, *[counted.get(m, F.col(m)).cast("long").alias(m) for m in MEASURES])


def _hashes(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, *MEASURES, failed)``, a row for each row of ``docs``: every rule evaluated once, ``failed`` with the bits of those that fail.

    A null or empty text has no words and fails ``few_words``; null ids and repeated rows stay as they are; an empty table gives an empty
    ledger; other columns of ``docs`` are not read. A text of any length is one row of work.
    """
    rows = measure(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").drop("text")
    bits = [F.when(F.expr(when), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, when in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.withColumn("failed", failed)


def judge(rows: DataFrame, policy: Policy) -> DataFrame:
    """A ledger with ``policy_version`` and ``kept``. The measurements are not looked at again."""
    return rows.withColumn("policy_version", F.lit(policy.version)).withColumn("kept", policy.keeps(F.col("failed")))


def patterns(rows: DataFrame, weight: str = "n_words") -> DataFrame:
    """``(failed, n, weight)``: the ledger as one row for each pattern of bits, at most 2**len(RULES) of them."""
    return rows.groupBy("failed").agg(F.count("*").alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("weight"))


def ablate(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """What each rule does under each policy: ``(version, rule, n_failed, n_kept, n_kept_without, words_kept, words_kept_without)``.

    ``n_failed`` counts rows that fail the rule, ``n_kept_without`` those that the policy would keep if it lacked the rule. All from sums over the
    patterns of bits, so any number of policies costs one pass over the ledger. A rule that a policy does not use leaves it as it is.
    """
    found, aggregates, out = patterns(rows), [], []
    for p in policies:
        for rule, bit in BIT.items():
            kept, without = p.keeps(F.col("failed")), p.keeps(F.col("failed"), rule)
            sums = {"n_failed": (F.col("failed").bitwiseAND(F.lit(bit)) != 0, "n"), "n_kept": (kept, "n"), "n_kept_without": (without, "n"), "words_kept": (kept, "weight"), "words_kept_without": (without, "weight")}
            total = [F.coalesce(F.sum(F.when(on, F.col(of))), F.lit(0)).cast("long").alias(name) for name, (on, of) in sums.items()]
            aggregates.append(F.struct(F.lit(p.version).alias("version"), F.lit(rule).alias("rule"), *total))
    out = found.agg(F.array(*aggregates).alias("all"))
    return out.select(F.inline("all"))


def overlaps(rows: DataFrame) -> DataFrame:
    """``(rule, other, n)``: rows that fail both of two rules."""
    names = list(BIT)
    both = [
        F.struct(F.lit(a).alias("rule"), F.lit(b).alias("other"), F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(F.lit(BIT[a] | BIT[b])) == BIT[a] | BIT[b], F.col("n"))), F.lit(0)).cast("long").alias("n"))
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    ]
    return patterns(rows).agg(F.array(*both).alias("all")).select(F.inline("all"))
