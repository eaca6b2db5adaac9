"""Arrays of numbers as short bytes in a row of a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed with their bytes apart: high bytes are mostly zero."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(8, "little") + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(x) else b"")


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(pa.decompress(data[8:], n * 4, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def flat(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of the stretches that begin at ``first``, end to end."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
