"""Words of whole Arrow batches as numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D. Texts are handled in slices of about
``SLICE_BYTES`` so that memory does not follow the batch; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE_CODES = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept between calls."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, SLICE_BYTES * 2), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of some consecutive texts. ``first[i]:first[i + 1]`` are the words of text ``row + i``."""

    row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    text_starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes, worked out over a part of the bytes at a time."""
        out, i = np.empty(len(self.starts), np.uint64), 0
        while i < len(out):
            begin = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, begin + SLICE_BYTES, side="right")))
            data = self.data[begin : self.ends[j - 1]]
            power, inverse = _powers_to(len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE_CODES[data] * power[: len(data)], dtype=np.uint64, out=sums[1:])
            starts = self.starts[i:j] - begin
            out[i:j] = mix((sums[self.ends[i:j] - begin] - sums[starts]) * inverse[starts])
            i = j
        return out


def slices(
    texts: pa.Array | pa.ChunkedArray, lower: bool = False, max_bytes: int = SLICE_BYTES, breaks: np.ndarray = SPACE
) -> Iterator[Words]:
    """The words of ``texts`` (null: none), a few texts at a time. ``breaks``: which bytes part words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])  # owns plain buffers
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1)
        bounds = offsets[row : stop + 1] - offsets[row]
        part = data[offsets[row] : offsets[stop]]
        yield _words(row, LOWER[part] if lower else part, bounds, breaks)
        row = stop


def _words(row: int, data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray) -> Words:
    word = ~breaks[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = word[edges]
    closes[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(row, data, starts, ends, np.searchsorted(starts, bounds), bounds)
