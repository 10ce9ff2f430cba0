"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Words are runs of bytes that are no separators of a table; A-Z count as a-z. A word's hash is a sum
of its bytes times a pseudo-random multiplier per place, mixed at the end, so two different words
share one with a chance near 2**-57.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=4)
def multipliers(n: int, seed: int = 1) -> np.ndarray:
    """Odd pseudo-random numbers, one per place."""
    at = np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)
    return mix(at) | _U(1)


@lru_cache(maxsize=2)
def byte_tables(spaces_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes separate words, and the lower case of each byte.

    Separators are space, tab, line and form feeds, vertical tab and carriage return, or all ASCII
    signs but letters and digits.
    """
    separates = np.zeros(256, bool)
    if spaces_only:
        separates[[32, *range(9, 14)]] = True
    else:
        separates[:128] = [not chr(i).isalnum() for i in range(128)]
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return separates, lower


def words(texts: list[bytes], spaces_only: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each text the index of its first word (and one more)."""
    separates, lower = byte_tables(spaces_only)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    inside = ~separates[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lengths = stops - starts
    begin = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    size = 64
    while size < lengths.max():
        size *= 4
    values = (lower[data[inside]].astype(np.uint64) + _U(1)) * multipliers(size)[place]
    return mix(np.add.reduceat(values, begin)), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; a shorter text is one shingle as a whole."""
    factors = multipliers(64, 77)
    n = len(hashes)
    if n >= k:
        total = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            total += hashes[j:n - k + 1 + j] * factors[j]
        total = mix(total)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(total[a:b - k + 1]))
        elif b > a:
            own = (hashes[a:b] * factors[:b - a]).sum(dtype=np.uint64) + _U(b - a)
            out.append(mix(np.array([own], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
