"""Words and word shingles of whole texts as 64-bit hashes, in numpy over many texts at once.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. The hash of a byte string is a polynomial over
random 64-bit values of its bytes modulo 2**64, mixed afterwards; equal words have equal hashes in every task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 5
M64 = (1 << 64) - 1
_R = np.random.Generator(np.random.PCG64(20240607))
LETTERS = _R.integers(1, M64, 256, dtype=np.uint64, endpoint=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FOLDED = LETTERS[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PLACES = _R.integers(1, M64, 16, dtype=np.uint64, endpoint=True) | np.uint64(1)
END = np.uint64(0x5851F42D4C957F2D)
#: Words per shingle.
SHINGLE = 5


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
    for out, b in ((up, BASE), (down, pow(BASE, -1, 1 << 64))):
        out[0] = 1
        k = 1
        while k < size:
            m = min(k, size - k)
            out[k : k + m] = out[:m] * np.uint64(pow(b, k, 1 << 64))
            k += m
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least."""
    return _powers(1 << max(20, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def prefix_sums(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    up, _ = powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[raw] * up[: len(raw)], out=sums[1:])
    return sums


def spans(raw: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words of all texts; first[i]:first[i+1] are those of text i."""
    inner = ~separator[raw]
    starts = inner.copy()
    starts[1:] &= ~inner[:-1]
    edges = at[(at > 0) & (at < len(raw))]
    starts[edges] = inner[edges]
    ends = inner.copy()
    ends[:-1] &= ~inner[1:]
    ends[edges - 1] = inner[edges - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, at)


def words(raw: np.ndarray, at: np.ndarray, letters: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): word hashes of all texts in order; first[i]:first[i+1] are those of text i. With LETTERS, A-Z stay as they are."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    s, e, first = spans(raw, at)
    sums, (_, down) = prefix_sums(raw, letters), powers(len(raw) + 1)
    return mix((sums[e] - sums[s]) * down[s]), first


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): of `size` words each, in order with repeats; fewer words make one shingle, none make none."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_first = np.concatenate(([0], np.cumsum(count)))
    if not out_first[-1]:
        return np.zeros(0, np.uint64), out_first
    begin = np.repeat(first[:-1], count) + np.arange(out_first[-1]) - np.repeat(out_first[:-1], count)
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    out = np.zeros(len(begin), np.uint64)
    for k in range(size):
        out += padded[begin + k] * PLACES[k]
    short = np.flatnonzero((n > 0) & (n < size))
    for i in short:
        own = hashes[first[i] : first[i + 1]]
        out[out_first[i]] = np.sum(own * PLACES[: len(own)], dtype=np.uint64) ^ END >> np.uint64(len(own))
    return mix(out), out_first


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, first = shingles(*words(raw, at), size)
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
