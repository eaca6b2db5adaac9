"""Sets of 64-bit hashes as bit arrays of bounded size, for tests inside tasks that an exact join follows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most 2**27 bits (16 MB), whatever the number of hashes; more hashes only let more rows through to the join.
MAX_BITS = 27


def bit_set(hashes: DataFrame, spare: int = 7, max_bits: int = MAX_BITS) -> np.ndarray:
    """The leading bits of column ``h`` as a bit array; 2**``spare`` bits a hash while that fits ``max_bits``.

    The words of the array are put together on the executors; the driver gets at most 2**(max_bits - 6) of them.
    """
    n = hashes.count()
    bits = int(min(max_bits, max(12, math.ceil(math.log2(n + 1)) + spare)))
    at = F.shiftrightunsigned("h", 64 - bits)
    mask = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(at & 63 AS INT))")
    parts = hashes.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), mask.alias("mask"))
    rows = parts.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return out


def in_bits(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the set: no for certain, or perhaps."""
    at = h >> np.uint64(64 - (len(bits).bit_length() - 1) - 6)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
