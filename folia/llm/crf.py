"""Toxic spans by a linear-chain conditional random field.

Labels mark whole documents, so the labelled tokens are found first: in a bounded sample of labelled documents, a token of a
toxic document counts as toxic if its word, or its first letters, are found in many toxic documents and hardly any other. The field
(two states, weights on a token's word, its first and last letters, and on transitions) is then fitted to these tokens by
the gradient of the conditional likelihood, and a logistic curve turns a document's marginals into a score. Scoring runs
forward and backward over whole texts, all documents of a batch side by side.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session

#: The bounds on clean and toxic labelled documents that a model is fitted on, and on the tokens of a training sequence.
SAMPLE = (3000, 1000)
SEQUENCE = 64
TOGETHER = 2048  # training sequences worked on at once
ROUNDS = 40
EDGES = ".,;:!?\"'()[]{}<>*_-/\\|"
NONE, TOXIC = 0, 1


def features(word: str) -> tuple[str, ...]:
    """What the model sees of a token: its lower-cased word without outer punctuation, and its ends. Nothing of the document besides."""
    w = word.lower().strip(EDGES)
    return (f"={w}", f"^{w[:4]}", f"^{w[:5]}", f"${w[-3:]}")


@dataclass
class Model:
    weights: dict[str, float]  # of state TOXIC against NONE
    transition: np.ndarray  # log potentials [from, to]
    curve: tuple[float, float, float]  # of a document's score: constant, by log odds of its likeliest token, by log of its expected tokens

    def emission(self, word: str) -> float:
        get = self.weights.get
        return get("", 0.0) + sum(get(f, 0.0) for f in features(word))


def marginals(emission: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Probability of TOXIC at each token of sequences that lie end to end, by odds passed forward and backward, all sequences at once."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0)
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    longest = int(sizes.max())
    active = len(sizes) - np.cumsum(np.bincount(sizes, minlength=longest + 1))[:longest]  # sequences longer than t
    at = np.concatenate([[0], np.cumsum(active)])
    step = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = at[step] + np.repeat(rank, sizes)
    e = np.empty(total)
    e[place] = np.exp(np.clip(emission, -30, 30))
    (t00, t01), (t10, t11) = np.exp(transition)
    ahead, back = np.empty(total), np.ones(total)
    u = np.ones(0)
    for t in range(longest):
        n, a = int(active[t]), int(at[t])
        ahead[a : a + n] = e[a : a + n] if t == 0 else e[a : a + n] * (t01 + t11 * u[:n]) / (t00 + t10 * u[:n])
        u = ahead[a : a + n]
    for t in range(longest - 2, -1, -1):
        n, a, b = int(active[t + 1]), int(at[t]), int(at[t + 1])
        w = e[b : b + n] * back[b : b + n]
        back[a : a + n] = (t10 + t11 * w) / (t00 + t01 * w)
    odds = ahead * back
    return (odds / (1 + odds))[place]


def _expected(emission: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and the expected number of each transition."""
    p = marginals(emission, sizes, transition)
    last = np.cumsum(sizes) - 1
    inner = np.ones(len(p), bool)
    inner[last] = False
    i = np.flatnonzero(inner)
    # pair marginals from the single ones of a two-state chain: forward odds at i, backward odds at i + 1
    t = np.exp(transition)
    start = np.zeros(len(p), bool)
    start[last + 1 - sizes] = True
    ahead, behind = _messages(emission, sizes, transition)
    e = np.exp(np.clip(emission, -30, 30))
    left = np.stack([np.ones(len(i)), ahead[i]], 1)
    right = np.stack([np.ones(len(i)), e[i + 1] * behind[i + 1]], 1)
    pair = left[:, :, None] * t * right[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return p, pair.sum(0)


def _messages(emission: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward odds (with a token's own emission) and backward odds, for sequences of nearly equal length."""
    longest = int(sizes.max())
    begin = np.cumsum(sizes) - sizes
    e = np.exp(np.clip(emission, -30, 30))
    (t00, t01), (t10, t11) = np.exp(transition)
    ahead, back = e.copy(), np.ones(len(e))
    for t in range(1, longest):
        i = begin[sizes > t] + t
        u = ahead[i - 1]
        ahead[i] = e[i] * (t01 + t11 * u) / (t00 + t10 * u)
    for t in range(longest - 2, -1, -1):
        i = begin[sizes > t + 1] + t
        w = e[i + 1] * back[i + 1]
        back[i] = (t10 + t11 * w) / (t00 + t01 * w)
    return ahead, back


def _distinct(texts: list[str]) -> list[list[str]]:
    """Words of the texts, without copies: a text goes if the least hash of its word pairs, in one of three orders, is an earlier one's."""
    seen: set = set()
    out = []
    for text in texts:
        words = list(map(sys.intern, text.split()))  # a word is held once, however often it stands
        pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words)
        least = {(k, min(zlib.crc32(p.encode(), k) for p in pairs)) for k in range(3)} if pairs else set()
        if words and not least & seen:
            out.append(words)
        seen |= least
    return out


def fit(clean: list[str], toxic: list[str]) -> Model:
    """A model from texts of the two classes; from one class alone, or none, a model that finds nothing toxic."""
    groups = [_distinct(clean), _distinct(toxic)]
    found = [Counter(f for words in g for f in {f for w in set(words) for f in features(w)[:3]}) for g in groups]
    share = len(groups[1]) / max(1, len(groups[0]) + len(groups[1]))

    def telling(n: int, other: int) -> bool:
        """Whether so many toxic documents are beyond chance, among all features, and at least 15 times the clean rate."""
        q = n / (n + other)
        gain = n * math.log(q / share) + (other * math.log((1 - q) / (1 - share)) if other else 0.0)
        return q > share and gain >= math.log(10 * len(found[1])) and n * (1 - share) >= 15 * (other + 0.5) * share

    marked = {f for f, n in found[1].items() if len(f) > 4 and telling(n, found[0][f])} if 0 < share < 1 else set()
    if not marked:
        return Model({"": -8.0}, np.zeros((2, 2)), (-4.0, 0.0, 0.0))
    known: dict[str, int] = {"": 0}
    del found
    counts = Counter(f for g in groups for words in g for f in {f for w in set(words) for f in features(w)})
    counts = Counter({f: n for f, n in counts.items() if n >= 3})
    cached: dict[str, tuple[list[int], int]] = {}

    def of(word: str) -> tuple[list[int], int]:
        if word not in cached:
            fs = features(word)
            cached[word] = ([0, *(known.setdefault(f, len(known)) for f in fs if f in counts)], int(any(f in marked for f in fs[:3])))
        return cached[word]

    # a token's emission is its word's, so features are held once for each distinct word
    numbers: dict[str, int] = {}
    rows, columns, tokens, gold, sizes = [], [], array("i"), array("b"), []
    for kind, g in enumerate(groups):
        for words in g:
            if kind == TOXIC and not any(of(w)[1] for w in words):
                continue
            for k in range(0, len(words), SEQUENCE):
                part = words[k : k + SEQUENCE]
                sizes.append(len(part))
                for w in part:
                    fs, y = of(w)
                    if w not in numbers:
                        rows.extend([len(numbers)] * len(fs))
                        columns.extend(fs)
                        numbers[w] = len(numbers)
                    tokens.append(numbers[w])
                    gold.append(y if kind == TOXIC else NONE)
    rows, columns, tokens, gold, sizes = np.array(rows, np.int32), np.array(columns, np.int32), np.array(tokens), np.array(gold), np.array(sizes)
    cached.clear()
    counts.clear()

    def by_feature(by_word) -> np.ndarray:
        return np.bincount(columns, by_word[rows], len(known))

    last = np.cumsum(sizes) - 1
    inner = np.ones(len(gold), bool)
    inner[last] = False
    i = np.flatnonzero(inner)
    seen = np.bincount(gold[i] * 2 + gold[i + 1], minlength=4).reshape(2, 2)
    target = by_feature(np.bincount(tokens, gold, len(numbers)))
    del inner, i, gold
    # sequences side by side, so many at a time
    parts = [(k, min(len(sizes), k + TOGETHER), int(last[k] + 1 - sizes[k]), int(last[min(len(sizes), k + TOGETHER) - 1]) + 1) for k in range(0, len(sizes), TOGETHER)]
    w, t = np.zeros(len(known)), np.zeros((2, 2))
    w[0] = -3.0
    gw, gt = np.full(len(known), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(ROUNDS):  # gradient ascent with a step of its own for each weight
        weight = np.bincount(rows, w[columns], len(numbers))
        mass, pairs = np.zeros(len(numbers)), np.zeros((2, 2))
        for first, stop, a, b in parts:
            p, more = _expected(weight[tokens[a:b]], sizes[first:stop], t)
            mass += np.bincount(tokens[a:b], p, len(numbers))
            pairs += more
        up, ut = target - by_feature(mass) - 0.05 * w, (seen - pairs) - 0.05 * t
        gw += up**2
        gt += ut**2
        w += 0.7 * up / np.sqrt(gw)
        t += 0.3 * ut / np.sqrt(gt)
    model = Model({f: float(w[k]) for f, k in known.items() if abs(w[k]) > 1e-4}, t, (0.0, 1.0, 0.0))
    x, y = [], []
    emission: dict[str, float] = {}
    for kind, g in enumerate(groups):
        for k in range(0, len(g), 100):  # so many documents side by side
            some = g[k : k + 100]
            lengths = np.array([len(words) for words in some])
            e = np.array([emission[v] if v in emission else emission.setdefault(v, model.emission(v)) for words in some for v in words])
            x.extend((1.0, *_summary(p)) for p in np.split(marginals(e, lengths, t), np.cumsum(lengths)[:-1]))
            y.extend([kind] * len(some))
    x, y = np.array(x), np.array(y, float)
    b = np.zeros(3)
    for _ in range(25):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (y - p) - 0.5 * b)
    model.curve = tuple(float(v) for v in b)
    return model


#: Words whose emissions a task keeps at a time.
MOST_WORDS = 300_000


def _summary(p: np.ndarray) -> tuple[float, float]:
    most = min(max(float(p.max(initial=0.0)), 1e-4), 1 - 1e-4)
    return math.log(most / (1 - most)), math.log(float(p.sum()) + 1e-3)


def labelled_sample(docs: DataFrame, labels: DataFrame, training: Column, text: str = "text", id_col: str = "doc_id", label: str = "toxic", most: tuple[int, int] = SAMPLE) -> tuple[list[str], list[str]]:
    """Whole texts of at most so many labelled documents, clean and toxic, chosen by a hash of their ids.

    training is a condition on the labels' ids. Only this bounded set of ids is broadcast, and only a text for each reaches the
    driver: of rows that share an id the first in order of their texts. An id with both labels counts as toxic.
    """
    wanted = labels.where(training & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label) != 0).alias("bad"))
    parts = [wanted.where(F.col("bad") == bad).orderBy(F.xxhash64(id_col), id_col).limit(most[bad]) for bad in (False, True)]
    rows = docs.select(id_col, text).where(F.col(text).isNotNull()).join(F.broadcast(parts[0].union(parts[1])), id_col)
    rows = rows.groupBy(id_col, "bad").agg(F.min(text).alias(text)).collect()
    rows.sort(key=lambda r: (r[id_col], r[text]))
    return [r[text] for r in rows if not r["bad"]], [r[text] for r in rows if r["bad"]]


def tag(docs: DataFrame, model: Model, text: str = "text", to: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """Adds a struct: score (0 to 1), predicted (score >= 0.5), spans (array of struct<start, stop, p>: tokens likelier toxic than not, by character).

    Whole texts, row by row, no shuffle. Null and empty texts have no spans and the score of a text without toxic tokens.
    keep chooses the columns that stay (all); one named like the struct is replaced.
    """
    session(docs)
    keep = [c for c in (docs.columns if keep is None else keep) if c != to]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("p", T.DoubleType())])
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", T.ArrayType(span))])
    kept = docs.select(*keep).schema
    schema = T.StructType([*kept.fields, T.StructField(to, kind)])
    arrow = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())])))])
    source = docs.select(*keep, F.col(text).alias("tagged text")) if text not in keep else docs.select(*keep)
    name = text if text in keep else "tagged text"

    def run(batches):
        known: dict[str, float] = {}
        b0, b1, b2 = model.curve
        for b in batches:
            texts = b.column(name).to_pylist()
            split = [(t or "").split() for t in texts]
            if len(known) > MOST_WORDS:
                known.clear()
            for w in {w for s in split for w in s if w not in known}:
                known[w] = model.emission(w)
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            p = marginals(np.fromiter((known[w] for s in split for w in s), np.float64, int(sizes.sum())), sizes, model.transition)
            at = np.concatenate([[0], np.cumsum(sizes)])
            out = []
            for k, t in enumerate(texts):
                own = p[at[k] : at[k + 1]]
                odds, expected = _summary(own)
                score = 1 / (1 + math.exp(-min(max(b0 + b1 * odds + b2 * expected, -30), 30)))
                hot = np.flatnonzero(own >= 0.5)
                spans = []
                if len(hot):
                    places = [m.span() for m in re.finditer(r"\S+", t)]
                    spans = [{"start": places[h][0], "stop": places[h][1], "p": float(own[h])} for h in hot]
                out.append({"score": score, "predicted": int(score >= 0.5), "spans": spans})
            columns = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, arrow)], names=[*keep, to])

    return source.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is in the fifth that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def trained(spark, sf_dir: str) -> Model:
    """A model from the labels outside the held-out fifth."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(*labelled_sample(docs, labels, ~held_out()))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tagged = tag(docs, trained(spark, sf_dir), keep=["doc_id"])
    return tagged.select("doc_id", held_out().alias("held_out"), F.col("toxicity.score").alias("score"), F.col("toxicity.predicted").alias("predicted"))
