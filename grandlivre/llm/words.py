"""Words and rolling hashes of UTF-8 text, over whole batches of documents at once.

A word is a longest run of bytes 0-9, A-Z (lower-cased), a-z and 0x80-0xFF, so letters outside ASCII
belong to words. Words never cross documents. A document that is null or has no such byte has no words.
"""

from __future__ import annotations

import numpy as np

_random = np.random.RandomState(20240607)
#: A random odd-ish 64-bit number for each byte value, and the base of the rolling hash with its inverse.
BYTE = _random.randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: For each byte its lower-cased form if it belongs to a word, else 0.
LOWER = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    LOWER[_b] = _b
for _b in range(0x41, 0x5B):
    LOWER[_b] = _b + 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse modulo 2**64, kept for the next call."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            up = np.full(size, BASE)
            down = np.full(size, _INVERSE)
            up[0] = down[0] = 1
            _powers.clear()
            _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _powers[size]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums of values[i] * BASE**i, from 0, so that any stretch's hash is a difference."""
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of values[start:end], the same wherever the stretch lies."""
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word of the documents at ``at``, and the number of words of each."""
    low = LOWER[data]
    inside = low > 0
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (first[:-1] | ~before))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    counts = np.diff(np.searchsorted(start, at))
    return start, end, stretch_hash(prefix_hash(BYTE[low]), start, end), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's runs of ``n`` words and their number; a shorter document with words has one."""
    ends = np.cumsum(counts)
    starts = ends - counts
    prefix = prefix_hash(hashes)
    many = np.maximum(counts - n + 1, np.minimum(counts, 1))
    total = int(many.sum())
    own = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(total)
    return stretch_hash(prefix, own, np.minimum(own + n, np.repeat(ends, many))), many
