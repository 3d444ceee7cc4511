"""Vectorised words and word shingles over UTF-8 buffers.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as runs of those
characters. A word's 64-bit hash is a polynomial over its bytes, taken from prefix sums modulo 2**64. Words of more than
``LONG`` bytes are hashed one by one by BLAKE2b: from about a thousand bytes on, there are words that such a polynomial
can't tell apart, whatever its base.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Bytes up to which a word's hash is a polynomial.
LONG = 255
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation: separators where punctuation shouldn't tell words apart.
PUNCTUATION = SPACE.copy()
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.RandomState(20240229)
STEP = _rng.randint(1, 2**62, 64, dtype=np.uint64) * U(2) + U(1)
_powers: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, U(base & (2**64 - 1)))
            steps[0] = U(1)
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(raw: np.ndarray, off: np.ndarray, lower: bool = True, between: np.ndarray = SPACE):
    """(row, start, end, hash) of each word, in order. ``off``: the rows' offsets into ``raw``; ``between``: separators."""
    if len(raw) == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, np.zeros(0, dtype=U)
    solid = ~between[raw]
    full = off[:-1] < off[1:]
    first, last = off[:-1][full], off[1:][full] - 1
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    opens[first] = solid[first]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    closes[last] = solid[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(off, start, side="right") - 1
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=U)
    letters = LOWER[raw] if lower else raw.astype(U)
    np.cumsum((letters + U(1)) * up[: len(raw)], out=sums[1:], dtype=U)
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))
    for i in np.flatnonzero(end - start > LONG).tolist():
        word = letters[start[i] : end[i]].astype(np.uint8).tobytes()
        hashes[i] = U(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
    return row, start, end, hashes


def shingle_hashes(row: np.ndarray, hashes: np.ndarray, k: int, n_rows: int):
    """(hash of each run of k words within a row, bounds): row i's hashes stand at bounds[i]:bounds[i + 1].

    A row of 1 to k-1 words has one shingle, its whole sequence.
    """
    n = len(hashes)
    counts = np.bincount(row, minlength=n_rows).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(counts)))
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(bounds[-1], dtype=U)
    if n == 0:
        return out, bounds
    if n >= k:
        acc = np.zeros(n - k + 1, dtype=U)
        for j in range(k):
            acc += hashes[j : n - k + 1 + j] * STEP[j]
        inside = row[: n - k + 1] == row[k - 1 :]
        whole = counts >= k
        place = np.repeat(whole, sizes)
        out[place] = mix(acc[inside] + U(k))
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = hashes[starts[i] : starts[i + 1]]
        out[bounds[i]] = mix(np.array([(own * STEP[: len(own)]).sum(dtype=U) + U(len(own))], dtype=U))[0]
    return out, bounds
