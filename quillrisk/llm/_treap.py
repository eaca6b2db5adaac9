"""A quadtree over a sparse grid of integers whose cells hold the maximum below them, in bit arrays.

The grid is a square of side 2**height. Every cell that holds a value is cut into four quarters down to single places. A bit says
whether a quarter holds anything, cells are numbered level by level, so that the i-th set bit is cell i + 1 (cell 0 is the whole grid),
and a cell stores how far its maximum lies below that of the cell around it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from quillrisk.llm._packed import pack, unpack

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Bits of a byte up to and including each place, the first on the left.
_UPTO = np.array([0xFF << (7 - i) & 0xFF for i in range(8)], np.uint8)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of ``x`` (below 2**32) moved to the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


@dataclass
class Treap:
    height: int
    bits: np.ndarray  # packed, four for each cell above the lowest level
    most: np.ndarray  # maximum of every cell
    before: np.ndarray  # set bits before each byte of bits

    @staticmethod
    def build(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[int, bytes, bytes]:
        """``(height, bits, drops)`` of positive ``values`` at distinct places, at least one."""
        height = max(1, int(max(rows.max(), columns.max())).bit_length())
        code = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code)
        code, most = code[order], values[order].astype(np.int64)
        bits, drops = [], []
        for _ in range(height):
            parent, quarter = code >> np.uint64(2), (code & np.uint64(3)).astype(np.int64)
            heads = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            of = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(parent)]))
            above = np.maximum.reduceat(most, heads)
            here = np.zeros(4 * len(heads), np.uint8)
            here[4 * of + quarter] = 1
            bits.append(here)
            drops.append(above[of] - most)
            code, most = parent[heads], above
        packed = np.packbits(np.concatenate(bits[::-1]))
        cells = len(packed).to_bytes(8, "little") + pa.compress(packed.tobytes(), "zstd", asbytes=True)
        return height, cells, pack(np.concatenate([most, *drops[::-1]]))

    @staticmethod
    def load(height: int, bits: bytes, drops: bytes) -> Treap:
        drop = unpack(drops).astype(np.int64)
        packed = np.frombuffer(pa.decompress(bits[8:], int.from_bytes(bits[:8], "little"), "zstd", asbytes=True), np.uint8)
        around = np.flatnonzero(np.unpackbits(packed)) >> 2  # of cell i + 1
        most, lo, hi = drop.copy(), 0, 1
        while hi < len(most):
            end = 1 + int(np.searchsorted(around, hi))
            most[hi:end] = most[around[hi - 1 : end - 1]] - drop[hi:end]
            lo, hi = hi, end
        before = np.zeros(len(packed), np.int64)
        np.cumsum(_ONES[packed[:-1]], out=before[1:])
        return Treap(height, packed, most, before)

    def down(self, cells: np.ndarray, quarters: np.ndarray) -> np.ndarray:
        """The cell of each quarter, 0 where it holds nothing."""
        at = 4 * cells + quarters
        byte, place = at >> 3, at & 7
        here = self.bits[byte]
        upto = here & _UPTO[place]
        child = self.before[byte] + _ONES[upto]
        return np.where((here >> (7 - place)) & 1, child, 0)
