"""Small documents with the awkward cases, and plain Python counterparts of shared definitions."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, hi long, row string"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def awkward(spark, extra=()):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names used inside the operators."""
    texts = [None, "", " \t\n", "one", "a b c", "The quick brown fox jumps over the lazy dog", "the Quick brown fox jumps over the lazy dog",
             "word " * 5000, "x" * 30000, "é ß 漢字   tail", "é ß 漢字   tail", *extra]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), 7, 8, "r") for i, t in enumerate(texts)]
    rows += [rows[4], rows[5], (None, "the null id", None, None, 3, 7, 8, "r")]
    return spark.createDataFrame(rows, SCHEMA)
