"""Word shingles of whole texts as 64-bit hashes, by numpy over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; a longer text is hashed alone.
SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U = np.uint64
STEP, BACK = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_random = np.random.default_rng(20240229)
LETTER = _random.integers(0, 1 << 64, 256, U)
LETTER[65:91] = LETTER[97:123]  # A-Z count as a-z
PLACE = _random.integers(0, 1 << 64, 64, U) | U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP and its inverse to the powers 0 to n - 1, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        for k, x in enumerate((STEP, BACK)):
            p = np.full(max(n, SLICE), x, U)
            p[0] = 1
            _powers[k : k + 1] = [np.multiply.accumulate(p)]
    return _powers[0][:n], _powers[1][:n]


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end, and the n + 1 offsets of each text's words."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(ends), np.int64)
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(LETTER[data] * up, out=total[1:])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(U)), np.searchsorted(start, ends).astype(np.int64)


def slices(ends: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most so many bytes together, or one longer text."""
    at, n = 0, len(ends) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, to
        at = to


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words; of all its words, if it has fewer; none without words."""
    for a, b in slices(ends):
        hashes, at = words(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
        runs = len(hashes) - k + 1
        joined = mix(sum((hashes[i : i + runs] * PLACE[i] for i in range(1, k)), hashes[:runs] * PLACE[0])) if runs > 0 else hashes[:0]
        for i in range(b - a):
            s, e = at[i], at[i + 1]
            if e - s >= k:
                yield np.unique(joined[s : e - k + 1])
            elif e > s:
                yield mix((hashes[s:e] * PLACE[: e - s]).sum(dtype=U, keepdims=True) + U(e - s))
            else:
                yield hashes[:0]
