"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file compiles to two machines. The normaliser reads characters and writes others: the longest rule of the file's
character map, spaces to word marks, a mark before the text. The piece machine has a state for every beginning of a piece,
an arc for each character that goes on, and where a piece ends an arc that writes its id and returns to the start; a character that no
piece reads has an arc of its own that writes the ids of its bytes. Composed with an input, this gives a lattice: an arc from
position to position for every piece that stands there. The tropical shortest path through it is the segmentation.

For a unigram model an arc weighs minus its piece's score. A byte-pair model merges the best-scored pair first; the same
segmentation is the one path whose neighbouring pieces would not have merged otherwise, so a state also knows the last piece, and
an arc (of weight one) may follow only where the merges of both as one string stop at the two. Texts compose run by run, as no piece reads
a word mark after another character; equal runs are composed once. A long run is composed in overlapping stretches side by
side; where two stretches agree on as many states as the longest piece has characters, their paths go on alike, and where they don't the
later one is walked again from the earlier one's states, so time is linear in a run's length.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, utf8
from .runs import RunCache

MARK = "\u2581"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
NOTHING = np.int64(1) << 40  # the rank of what is no piece
NO_ARC = np.int32(-(1 << 31))
START = -1  # the state before the first character
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Runs longer than LONG characters are composed in stretches of STRETCH, each begun WARM characters early, AT_ONCE at a time.
LONG, STRETCH, WARM, AT_ONCE = 256, 448, 64, 128


def _fields(data: bytes):
    """Number and value of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """The rules (bytes read, bytes written) of a file's character map: a double-array trie, then the strings it points to."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    offset = (units >> 10) << ((units & (1 << 9)) >> 6)
    out, todo = {}, [(0, b"")]
    every = np.arange(256)
    while todo:
        node, read = todo.pop()
        at = node ^ int(offset[node])
        if read and units[node] >> 8 & 1:
            value = int(units[at]) & 0x7FFFFFFF
            out[read] = texts[value : texts.index(b"\0", value)]
        child = at ^ every
        child = np.where(child < len(units), child, 0)
        good = units[child] & ((1 << 31) | 0xFF) == every
        good[0] = False
        todo += [(int(child[c]), read + bytes([c])) for c in np.flatnonzero(good)]
    return out


@dataclass
class Normaliser:
    """What a text becomes before pieces read it: at each place the longest rule applies, else a character stands for itself."""

    rules: dict[bytes, bytes] = field(default_factory=dict)
    prefix: bool = True
    shrink: bool = False  # runs of spaces count as one, those around the text go

    @cached_property
    def trie(self) -> dict:
        root: dict = {}
        for read, write in self.rules.items():
            node = root
            for c in read:
                node = node.setdefault(c, {})
            node[-1] = write
        return root

    def rewrite(self, text: str) -> str:
        """The text after the character map."""
        if not self.rules:
            return text
        data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
        while at < len(data):
            node, end, write, k = self.trie, at, None, at
            while k < len(data) and (node := node.get(data[k])) is not None:
                k += 1
                if -1 in node:
                    end, write = k, node[-1]
            if write is None:
                end = at + 1
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end += 1
                write = data[at:end]
            out.append(write)
            at = end
        return b"".join(out).decode("utf-8", "replace")

    def spaces(self, column: pa.Array) -> pa.Array:
        """Texts with spaces where marks come: one before each text that isn't empty, if the file says so."""
        if self.rules:
            column = pa.array([self.rewrite(t) for t in column.to_pylist()], pa.string())
        column = pc.replace_substring(column, MARK, " ")
        if self.shrink:
            column = pc.utf8_trim(pc.replace_substring_regex(column, " +", " "), " ")
        return column


@dataclass
class Transducer:
    """A compiled model."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model: int
    normaliser: Normaliser
    rank: np.ndarray  # of pieces that can be read: single characters first, then by score
    left: np.ndarray  # the two pieces that were merged last into a piece; itself twice for a single character
    right: np.ndarray

    @classmethod
    def load(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds, model = [], [], [], UNIGRAM
        prefix, escape, shrink, chars = True, True, True, b""
        for n, value in _fields(data):
            if n == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                pieces.append(piece)
                scores.append(score)
                kinds.append(kind)
            elif n == 2:
                model = next((v for k, v in _fields(value) if k == 3), UNIGRAM)
            elif n == 3:
                for k, v in _fields(value):
                    chars, prefix, shrink, escape = (v if k == 2 else chars), (bool(v) if k == 3 else prefix), (bool(v) if k == 4 else shrink), (bool(v) if k == 5 else escape)
        if not escape or model not in (UNIGRAM, BPE) or USER in kinds:
            raise ValueError("only unigram and byte-pair models with escaped spaces and without user-defined symbols are compiled")
        if any(MARK in p.lstrip(MARK) for p, k in zip(pieces, kinds, strict=True) if k == NORMAL):
            raise ValueError("a piece reads a word mark after another character")
        return cls._compile(pieces, scores, kinds, model, Normaliser(character_map(chars), prefix, shrink))

    @classmethod
    def _compile(cls, pieces, scores, kinds, model, normaliser) -> Transducer:
        ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        n = len(pieces)
        rank, left, right = np.full(n, NOTHING), np.arange(n), np.arange(n)
        single = sorted(i for p, i in ids.items() if len(p) == 1)
        rank[single] = np.arange(len(single))
        merged = sorted((i for p, i in ids.items() if len(p) > 1), key=lambda i: (-scores[i], i))
        rank[merged] = np.arange(len(single), len(single) + len(merged))
        if model == BPE:
            for i in merged:
                path = merge(list(pieces[i]), ids, scores, stop=1)
                if path is None:
                    rank[i] = NOTHING  # the merges never make it
                else:
                    left[i], right[i] = ids.get(path[0], i), ids.get(path[1], i)
        return cls(pieces, scores, kinds, model, normaliser, rank, left, right)

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL and self.rank[i] < NOTHING}

    @cached_property
    def every(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}

    @cached_property
    def bytes_ids(self) -> list[int]:
        at = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        unknown = self.kinds.index(UNKNOWN)
        return [at.get(f"<0x{b:02X}>", unknown) for b in range(256)]

    @cached_property
    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the pieces' characters, ascending, and their ids."""
        keys = sorted((hash_of(p), i) for p, i in self.ids.items())
        out = np.array([k for k, _ in keys], np.uint64), np.array([i for _, i in keys], np.int64)
        if len(np.unique(out[0])) < len(out[0]):
            raise ValueError("two pieces have one hash")
        return out

    @cached_property
    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's hash, and STEP to the power of its length."""
        h = np.array([hash_of(p) for p in self.pieces], np.uint64)
        return h, np.array([pow(int(STEP), len(p), 1 << 64) for p in self.pieces], np.uint64)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    @cached_property
    def texts(self) -> list[bytes]:
        """What each id writes when decoded."""
        return [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        keys, ids = self.hashes
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, ids[at], -1)

    def apart(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether merging p and q's characters as one string ends with p and q (ids; -1 is a character that no piece reads).

        Undoes the merges of both from the last: at each stage the pieces at the seam must not have merged before what was
        undone was made; pieces right of the seam lose ties.
        """
        ok = np.ones(len(p), bool)
        i = np.flatnonzero((p >= 0) & (q >= 0))
        a, b = p[i], q[i]
        limit = np.full(len(i), NOTHING)
        h, up = self.own
        while len(i):
            seam = self.find(h[a] * up[b] + h[b])
            r = np.where(seam >= 0, self.rank[seam], NOTHING)
            bad = r < limit
            ok[i[bad]] = False
            go = ~bad
            i, a, b, limit = i[go], a[go], b[go], limit[go]
            ra, rb = self.rank[a], self.rank[b]
            fa, fb = self.left[a] == a, self.left[b] == b
            first = np.where(fa, False, fb | (ra > rb))  # undo the later merge
            limit = np.where(first, ra, rb + 1)
            done = fa & fb
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
            go = ~done
            i, a, b, limit = i[go], a[go], b[go], limit[go]
        return ok

    @cached_property
    def arcs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The piece machine: keys (state << 21 | character), ascending, the states they lead to, and the piece that ends in each state (-1: none)."""
        states: dict[str, int] = {"": 0}
        keys: list[tuple[int, int]] = []
        ends = [-1]
        for piece, i in sorted(self.ids.items()):
            for k in range(1, len(piece) + 1):
                if piece[:k] not in states:
                    states[piece[:k]] = len(ends)
                    keys.append((states[piece[: k - 1]] << 21 | ord(piece[k - 1]), len(ends)))
                    ends.append(-1)
            ends[states[piece]] = i
        keys.sort()
        return np.array([k for k, _ in keys], np.int64), np.array([v for _, v in keys], np.int32), np.array(ends, np.int32)

    def compose(self, chars: np.ndarray) -> np.ndarray:
        """The lattice of m inputs of n characters: (m, n + 1, longest), arcs by the position where they end and the characters they read, less one.

        An arc is a piece's id, or minus one minus its character for a character that no piece reads.
        """
        keys, to, ends = self.arcs
        m, n = chars.shape
        out = np.full((m, n + 1, self.longest), NO_ARC, np.int32)
        row, at = (x.ravel() for x in np.indices((m, n)))
        state = np.zeros(len(row), np.int64)
        for k in range(min(self.longest, n)):
            if k:
                go = at + k < n
                row, at, state = row[go], at[go], state[go]
            key = state << 21 | chars[row, at + k]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = keys[place] == key
            if not k:
                none = ~there
                out[row[none], at[none] + 1, 0] = -1 - chars[row[none], at[none]]
            row, at, state = row[there], at[there], to[place[there]].astype(np.int64)
            piece = ends[state]
            full = piece >= 0
            out[row[full], at[full] + 1 + k, k] = piece[full]
            if not k:  # the first character of a longer piece need not be a piece itself
                none = ~full
                out[row[none], at[none] + 1, 0] = -1 - chars[row[none], at[none]]
            if not len(row):
                break
        return out

    @cached_property
    def weights(self) -> tuple[np.ndarray, float]:
        """Of the pieces' arcs, and of those of characters that no piece reads."""
        if self.model == BPE:
            return np.ones(len(self.scores)), 1.0
        weight = np.array([-x for x in self.scores])
        return weight, weight.max() + 10.0

    def walk(self, lattice: np.ndarray, state: np.ndarray, cost: np.ndarray, begin: int) -> np.ndarray:
        """Fills state (the last arc of the shortest path to each position) and cost from position begin on; returns how many characters that arc reads."""
        weight, unread = self.weights
        m, n, _ = lattice.shape
        size = np.ones((m, n), np.int16)
        rows = np.arange(m)
        for j in range(begin, n):
            here = lattice[:, j, : min(j, self.longest)]
            r, k = np.nonzero(here != NO_ARC)
            arc = here[r, k].astype(np.int64)
            before = j - 1 - k
            total = cost[r, before] + np.where(arc >= 0, weight[np.maximum(arc, 0)], unread)
            if self.model == BPE:
                total[~self.apart(state[r, before], arc)] = np.inf
            best = np.full(here.shape, np.inf)
            best[r, k] = total
            k = best.argmin(1)
            cost[:, j], state[:, j], size[:, j] = best[rows, k], here[rows, k], k + 1
        return size

    def fresh(self, m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        state, cost = np.full((m, n + 1), START, np.int64), np.full((m, n + 1), np.inf)
        cost[:, 0] = 0
        return state, cost

    def output(self, state: list[int], size: list[int]) -> list[int]:
        """What the arcs on the path to the last position write."""
        out: list[int] = []
        j = len(state) - 1
        while j > 0:
            arc = state[j]
            if arc >= 0:
                out.append(arc)
            else:
                out += [self.bytes_ids[x] for x in reversed(chr(-1 - arc).encode("utf-8", "surrogatepass"))]
            j -= size[j]
        return out[::-1]

    def shortest(self, words: list[str]) -> list[list[int]]:
        """The output of the shortest path of each run."""
        out: list = [None] * len(words)
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self._long(w)
            else:
                by.setdefault(len(w), []).append(k)
        for n, group in by.items():
            most = max(1, (1 << 17) // max(n, 1))
            for k in range(0, len(group), most):
                part = group[k : k + most]
                chars = characters("".join(words[j] for j in part)).reshape(len(part), n)
                state, cost = self.fresh(len(part), n)
                size = self.walk(self.compose(chars), state, cost, 1)
                for j, a, b in zip(part, state.tolist(), size.tolist(), strict=True):
                    out[j] = self.output(a, b)
        return out

    def _long(self, word: str) -> list[int]:
        chars, back = characters(word), self.longest
        n = len(chars)
        state, size, cost = np.full(n + 1, START, np.int64), np.ones(n + 1, np.int64), np.full(n + 1, np.inf)
        cost[0] = 0
        warm = max(WARM, 2 * back)
        starts = list(range(0, n, STRETCH))
        for k in range(0, len(starts), AT_ONCE):
            part = starts[k : k + AT_ONCE]
            whole = [s for s in part if s >= warm and s + STRETCH <= n]
            width = warm + STRETCH
            if whole:
                lattice = self.compose(np.stack([chars[s - warm : s + STRETCH] for s in whole]))
                states, costs = self.fresh(len(whole), width)
                sizes = self.walk(lattice, states, costs, 1)
            for s in part:
                e = min(n, s + STRETCH)
                if s in whole:
                    r = whole.index(s)
                    mine, theirs = costs[r, warm - back + 1 : warm + 1], cost[s - back + 1 : s + 1]
                    if (states[r, warm - back + 1 : warm + 1] == state[s - back + 1 : s + 1]).all() and np.allclose(mine - mine[-1], theirs - theirs[-1], rtol=0, atol=1e-9):
                        state[s + 1 : e + 1], size[s + 1 : e + 1] = states[r, warm + 1 :], sizes[r, warm + 1 :]
                        cost[s + 1 : e + 1] = costs[r, warm + 1 :] - mine[-1] + cost[s]
                        continue
                b = max(0, s - back)  # from the states before
                lattice = self.compose(chars[None, b:e])
                own, paid = state[None, b : e + 1].copy(), cost[None, b : e + 1].copy()
                reads = self.walk(lattice, own, paid, s - b + 1)
                state[s + 1 : e + 1], size[s + 1 : e + 1], cost[s + 1 : e + 1] = own[0, s - b + 1 :], reads[0, s - b + 1 :], paid[0, s - b + 1 :]
        return self.output(state.tolist(), size.tolist())

    def marks(self, n: int) -> list[int]:
        """Ids of n word marks in a row; pieces of marks may tie in score, so these few strings are merged one by one."""
        if self.model == UNIGRAM:
            return self.shortest([MARK * n])[0]
        out = []
        for p in merge([MARK] * n, self.every, self.scores):
            i = self.every.get(p)
            out += [i] if i is not None else [self.bytes_ids[x] for x in p.encode()]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The text that ids stand for, without the space that was put before it."""
        out = b"".join(map(self.texts.__getitem__, ids))
        return out[1:] if self.normaliser.prefix and out[:1] == b" " else out


def hash_of(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def merge(parts: list[str], ids: dict[str, int], scores: list[float], stop: int = 0) -> list[str] | None:
    """Merges the best-scored pair, the leftmost of equals, until none is a piece; with stop = 1, gives the two parts that the last merge joins, None if parts remain."""
    parts, n = list(parts), len(parts)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    queue: list[tuple[float, int, str]] = []

    def offer(k: int) -> None:
        if k >= 0 and after[k] >= 0 and (i := ids.get(both := parts[k] + parts[after[k]])) is not None:
            heapq.heappush(queue, (-scores[i], k, both))

    for k in range(n - 1):
        offer(k)
    last, left = None, n
    while queue:
        _, k, both = heapq.heappop(queue)
        if not parts[k] or after[k] < 0 or parts[k] + parts[after[k]] != both:
            continue  # one of the two has merged otherwise
        last, left, gone = [parts[k], parts[after[k]]], left - 1, after[k]
        parts[k], parts[gone], after[k] = both, "", after[gone]
        if after[k] >= 0:
            before[after[k]] = k
        offer(before[k])
        offer(k)
    return [p for p in parts if p] if not stop else last if left == 1 else None


class TextEncoder:
    """Whole texts through a transducer; what it gave for each short run is kept."""

    def __init__(self, machine: Transducer):
        self.machine = machine
        self.cache = RunCache("<u4", self._runs)

    def _runs(self, runs: list[str]) -> list[list[int]]:
        """Runs are marks, then characters without one."""
        m = self.machine
        plain = [c for c in runs if not c.startswith(MARK * 2) and c != MARK]
        ids = dict(zip(plain, m.shortest(plain), strict=True))
        for c in runs:
            if c not in ids:
                word = c.lstrip(MARK)
                n = len(c) - len(word)
                tail = m.shortest([MARK + word])[0] if word else []
                alone = bool(tail) and tail[0] == m.every.get(MARK)
                ids[c] = m.marks(n) if not word else m.marks(n) + tail[1:] if alone else (m.marks(n - 1) if n > 1 else []) + tail
        return [ids[c] for c in runs]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and the n + 1 offsets; null counts as empty."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        texts = self.machine.normaliser.spaces(texts.fill_null("") if texts.null_count else texts)
        full = np.asarray(pc.not_equal(texts, ""))
        words = pc.split_pattern(texts, " ")
        at = np.asarray(words.offsets).astype(np.int64)
        at = at - at[0]
        flat = words.flatten().dictionary_encode()
        index, names = np.asarray(flat.indices).astype(np.int64), flat.dictionary.to_pylist()
        text_of = np.repeat(np.arange(n), np.diff(at))
        first = np.zeros(len(index), bool)
        first[at[:-1][np.diff(at) > 0]] = True
        # a mark comes before every part but an unmarked text's first
        bare = first & (not self.machine.normaliser.prefix)
        runs = [MARK + w for w in names]
        keep = full[text_of]
        empty = np.array([not w for w in names], bool)[index] & keep if names else np.zeros(0, bool)
        odd = bare & keep
        if empty.any() or odd.any():
            place = {r: i for i, r in enumerate(runs)}

            def number(run: str) -> int:
                if run not in place:
                    place[run] = len(runs)
                    runs.append(run)
                return place[run]

            # parts without characters add their marks to the next part of the text, or are a run of marks at its end
            stops = np.flatnonzero(empty | odd)
            k = 0
            while k < len(stops):
                i = int(stops[k])
                if odd[i]:
                    if names[index[i]]:
                        index[i] = number(names[index[i]])
                    else:
                        keep[i] = False
                    k += 1
                    continue
                end = i
                while end < len(index) and empty[end] and text_of[end] == text_of[i] and (end == i or not odd[end]):
                    end += 1
                more = end < len(index) and text_of[end] == text_of[i]
                keep[i:end] = False
                if more:
                    index[end] = number(MARK * (end - i + 1) + names[index[end]])
                else:
                    index[end - 1], keep[end - 1] = number(MARK * (end - i)), True
                while k < len(stops) and stops[k] < end:
                    k += 1
        index, text_of = index[keep], text_of[keep]
        ids, ends = self.cache.encode(pa.array(runs, pa.string()), index)
        return ids, ends[np.searchsorted(text_of, np.arange(n + 1))]


_encoders: dict[int, TextEncoder] = {}


def encoder(machine: Transducer) -> TextEncoder:
    """A worker's encoder of a model; it outlives a task."""
    key = zlib.crc32("\n".join(machine.pieces).encode()) ^ len(machine.normaliser.rules)
    if key not in _encoders:
        _encoders[key] = TextEncoder(machine)
    return _encoders[key]


def encode(docs: DataFrame, machine: Transducer, text: str = "text", to: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds the piece ids of every whole text as array<int>. Null and empty texts have none. A column of that name is replaced."""
    session(docs)
    keep = [c for c in (docs.columns if keep is None else keep) if c != to]
    source = docs.select(*keep, F.col(text).alias("text to encode"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(to, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        coder = encoder(machine)
        for b in batches:
            ids, at = coder.encode(b.column("text to encode"))
            column = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], column], names=[*keep, to])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, machine: Transducer, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for; null for null. Bytes that are no UTF-8 become U+FFFD."""
    session(df)
    keep = [c for c in df.columns if c != to]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(to, T.StringType())])

    def run(batches):
        for b in batches:
            out = [None if x is None else machine.decode(x).decode("utf-8", "replace") for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, pa.string())], names=[*keep, to])

    return df.select(*keep).mapInArrow(run, schema)


def encoded_digest(docs: DataFrame, machine: Transducer, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For every text: n_ids, n_bytes (ids of single bytes), ids_crc32 (of the ids as little-endian 32-bit integers), round_trip (whether decoding the ids gives the text)."""
    session(docs)

    def run(batches):
        coder = encoder(machine)
        single = np.zeros(len(machine.pieces), bool)
        single[[i for i, k in enumerate(machine.kinds) if k == BYTE]] = True
        for b in batches:
            raw, ends = utf8(b.column("text"))
            raw = raw.tobytes()
            texts = [raw[ends[k] : ends[k + 1]] for k in range(b.num_rows)]
            ids, at = coder.encode(b.column("text"))
            fallback = np.concatenate([[0], np.cumsum(single[ids])])
            lists = ids.tolist()
            packed = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(packed[4 * at[k] : 4 * at[k + 1]]) for k in range(b.num_rows)]
            same = [machine.decode(lists[at[k] : at[k + 1]]) == t for k, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(at)), pa.array(fallback[at[1:]] - fallback[at[:-1]]), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "n_bytes", "ids_crc32", "round_trip"]
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_ids long, n_bytes long, ids_crc32 long, round_trip boolean")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every text encoded to piece ids and decoded again."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded_digest(docs, Transducer.load(str(public_tokenizers.path("piece_bpe_32k.model"))))
