"""Sparse 0/1 matrices by rows (CSR) and their products, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quillrisk.llm._packed import flat


@dataclass
class Csr:
    """Row ``i`` holds the columns ``columns[first[i]:first[i + 1]]`` with ``values`` beside them."""

    first: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def stretches(cls, sizes: np.ndarray) -> Csr:
        """Row ``i`` holds the next ``sizes[i]`` columns, from the left: tokens and the bytes they cover."""
        first = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        return cls(first, np.arange(first[-1]), np.ones(first[-1], np.int64), int(first[-1]))

    @classmethod
    def members(cls, group: np.ndarray, width: int) -> Csr:
        """Row ``i`` holds the one column ``group[i]``."""
        return cls(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), width)

    @property
    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def transpose(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        first = np.r_[0, np.cumsum(np.bincount(self.columns, minlength=self.width))]
        return Csr(first, self.rows[order], self.values[order], len(self.first) - 1)

    def product(self, other: Csr) -> Csr:
        """Gustavson's product: a row is the sum of the rows of ``other`` that its columns name, equal columns added up."""
        size = np.diff(other.first)[self.columns]
        at = flat(other.first[self.columns], size)
        row, column, value = np.repeat(self.rows, size), other.columns[at], np.repeat(self.values, size) * other.values[at]
        key = row * max(1, other.width) + column
        order = np.argsort(key, kind="stable")  # nearly in order already
        key, value = key[order], value[order]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
        total = np.add.reduceat(value, heads) if len(heads) else value
        row, column = row[order][heads], column[order][heads]
        return Csr(np.searchsorted(row, np.arange(len(self.first))), column, total, other.width)
