"""Rows told apart by their content, and column names that cannot meet a user's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores after it until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def column(name: str) -> Column:
    """A top-level column whatever its name has in it."""
    return F.col(f"`{name.replace('`', '``')}`")


def row_key(df: DataFrame, *names: str) -> Column:
    """128 bits of the content of ``names`` (all columns, if none are given): rows of one key are equal in them."""
    fields = [column(n).cast("string") if t == "void" else column(n) for n, t in df.dtypes if not names or n in names]
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}  # JSON has milliseconds otherwise
    return F.md5(F.to_json(F.struct(*[f.alias(f"c{i}") for i, f in enumerate(fields)]), {"ignoreNullFields": "false", **exact}))
