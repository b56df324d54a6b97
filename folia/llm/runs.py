"""Texts encoded run by run: what an encoder gave for each run of characters between white space is kept and gathered by index."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Runs that a worker keeps at a time, the characters of the longest that is kept, and their ids together.
MOST, LONGEST, MOST_IDS = 500_000, 64, 4_000_000


class RunCache:
    """Encodes texts through encode_runs, a function from distinct runs to their ids, asked once for each run that isn't kept.

    Arrow splits the texts and numbers the distinct runs, so Python sees each of them once a batch. Longer runs are encoded anew
    in each batch, so memory is bounded in bytes, not in entries alone.
    """

    def __init__(self, dtype, encode_runs: Callable[[list[str]], list]):
        self.dtype, self.encode_runs = np.dtype(dtype), encode_runs
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _learn(self, runs: list[str]) -> dict[str, int]:
        """Places of new runs; only the short ones are kept."""
        runs = sorted(runs, key=len)
        short = sum(len(r) <= LONGEST for r in runs)
        encoded = self.encode_runs(runs)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ends = self.used + np.cumsum(sizes)
        while (ends[-1] if len(ends) else 0) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if len(ends):
            self.flat[self.used : ends[-1]] = np.fromiter(chain.from_iterable(encoded), self.dtype, int(sizes.sum()))
        first = len(self.known)
        while first + len(runs) > len(self.size):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.begin[first : first + len(runs)], self.size[first : first + len(runs)] = ends - sizes, sizes
        places = dict(zip(runs, range(first, first + len(runs)), strict=True))
        self.known.update(zip(runs[:short], range(first, first + short), strict=True))
        if short:
            self.used = int(ends[short - 1])
        return places

    def encode(self, words: pa.Array, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words[index] end to end, and their n + 1 offsets; words are distinct."""
        names = words.to_pylist()
        new = [w for w in names if w not in self.known]
        if new and (len(self.known) + len(new) > MOST or self.used > MOST_IDS):  # what is kept goes, so learn all that this batch needs
            self._clear()
            new = names
        learned = self._learn(new) if new else {}
        known = self.known
        place = np.fromiter((known[w] if w in known else learned[w] for w in names), np.int64, len(names))[index]
        size = self.size[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.begin[place] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, each run's alone, and the n + 1 offsets; null counts as empty."""
        if not len(column):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        words = pc.ascii_split_whitespace(column.fill_null("") if column.null_count else column)
        at = np.asarray(words.offsets).astype(np.int64)
        flat = words.flatten().dictionary_encode()
        ids, ends = self.encode(flat.dictionary, np.asarray(flat.indices))
        return ids, ends[at - at[0]]
