"""64-bit hashes of words and word runs, computed over a whole batch of texts with numpy.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z lower-cased. Its hash is a
polynomial of its bytes modulo 2^64, mixed with its length; it depends on the
word alone, so equal words have equal hashes in every task.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C55
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0.. and its inverses, n of each; kept between batches."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, b in enumerate((BASE, BASE_INVERSE)):
            out = np.ones(size, np.uint64)
            have = 1
            while have < size:
                step = np.uint64(pow(b, have, 1 << 64))
                out[have : 2 * have] = out[: min(have, size - have)] * step
                have *= 2
            _POWERS[k] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch in order, and for each text where its words begin (one more entry than texts)."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[bounds < n]
    begins[bounds] = inside[bounds]
    ends = np.empty(n + 1, bool)
    ends[1:n] = inside[:-1] & (~inside[1:] | begins[1:])
    ends[n] = inside[-1]
    ends[0] = False
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), np.searchsorted(start, offsets)


def pieces(offsets: np.ndarray, most: int = 1 << 21):
    """Ranges (first, last) of texts holding about ``most`` bytes together; one long text is a range of its own."""
    first = 0
    rows = len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word runs of ``width``; a shorter text is one run, an empty one none."""
    out = []
    n = len(words)
    odd = [np.uint64(pow(0xA24BAED4963EE407, k + 1, 1 << 64) | 1) for k in range(width)]
    runs = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        runs += words[k : n - width + 1 + k] * odd[k] if len(runs) else np.uint64(0)
    runs = mix(runs)
    for first, last in zip(at[:-1].tolist(), at[1:].tolist()):
        if last - first >= width:
            out.append(np.unique(runs[first : last - width + 1]))
        elif last > first:
            h = np.array([last - first], np.uint64)
            for k in range(last - first):
                h = h * odd[0] + words[first + k : first + k + 1] * odd[k]
            out.append(mix(h))
        else:
            out.append(np.empty(0, np.uint64))
    return out


SKETCH = 64
_SEEDS = mix(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64)).reshape(2, SKETCH)


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens of non-empty sets, a row for each set."""
    grams = np.concatenate(sets)
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    out = np.empty((len(sets), SKETCH), np.uint64)
    for k in range(SKETCH):
        out[:, k] = np.minimum.reduceat((grams ^ _SEEDS[0, k]) * (_SEEDS[1, k] | np.uint64(1)), first)
    return mix(out ^ _SEEDS[0])


@lru_cache(maxsize=64)
def least_agreeing(chance: float, miss: float) -> int:
    """In how many places two sketches agree at least, but for a probability of ``miss``, if each place agrees with ``chance``."""
    total = 0.0
    for k in range(SKETCH + 1):
        total += math.comb(SKETCH, k) * chance**k * (1 - chance) ** (SKETCH - k)
        if total > miss:
            return k
    return SKETCH
