"""Texts of an Arrow column as flat NumPy arrays, for the operators that cut them into grams."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, first byte of each row and the end); a null is an empty text."""
    col = pc.cast(pc.fill_null(col, ""), pa.large_string())
    _, offsets, data = col.buffers()
    bounds = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[bounds[0]:bounds[-1]], bounds - bounds[0]


def text_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, first one of each row and the end); no nulls."""
    texts = [b.decode("utf-8", "replace") for b in pc.cast(col, pa.binary()).to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), bounds


def row_blocks(bounds: np.ndarray, most: int):
    """(first row, end row) of consecutive blocks of about ``most`` places; a longer text
    is a block of its own."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def counted_up(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and number within the row, of ``count`` places in each row."""
    own = np.repeat(np.arange(len(count)), count)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalising mix, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
