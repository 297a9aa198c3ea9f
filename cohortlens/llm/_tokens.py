"""Vectorised words of UTF-8 text: positions and 64-bit hashes, on whole Arrow blocks.

Word classes are ASCII rules, so they can be told from bytes alone: every byte
from 0x80 on belongs to a word.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ._common import mix64

_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PIECE = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: 1 where the byte belongs to a word, after A-Z have been lowered.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, 9, 10, 11, 12, 13]] = False


@dataclass
class Tokens:
    """Words of a block of texts. ``first[i]:first[i+1]`` are the words of text i."""
    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray  # lowered bytes

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def tokenise(data: np.ndarray, bounds: np.ndarray, word_byte: np.ndarray, fold: np.ndarray = LOWER) -> Tokens:
    """Words of the texts ``data[bounds[i]:bounds[i+1]]`` (bytes mapped by ``fold``: A-Z lowered).

    A word's hash is a polynomial over random letter values, from prefix sums, so
    that no loop runs over words; pieces bound the 8-byte temporaries."""
    data = fold[data]
    inside = word_byte[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        starts[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    del starts, ends, inside
    hashes = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + _PIECE, side="right")))
        at, to = start[lo], end[hi - 1]
        total = np.zeros(to - at + 1, np.uint64)
        np.cumsum(_LETTER[data[at:to]] * _powers(_BASE, to - at), out=total[1:])
        s, e = start[lo:hi] - at, end[lo:hi] - at
        hashes[lo:hi] = (total[e] - total[s]) * _powers(_INVERSE, to - at + 1)[s]
        lo = hi
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Tokens(mix64(hashes), doc, start, end, first, data)


def grams(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every run of k words inside one text, in order."""
    n = len(t.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h += mix64(t.hash[i:n + i] + _GRAM[i]) * _GRAM[k + i]
    keep = t.doc[:n] == t.doc[k - 1:]
    return mix64(h[keep]), t.doc[:n][keep]
