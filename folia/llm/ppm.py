"""Language-model scores by prediction by partial matching over bytes.

The trie of byte contexts up to ORDER is a table of counted n-grams for each depth, counted in the training documents. A
byte's probability is looked for at its longest context; where the context has not seen it, it escapes (method C: distinct
symbols against occurrences) to the next shorter one, in which the symbols that the longer one has seen are excluded. With
full counts a context's symbols are among those of every shorter one, so the exclusions are sums over the deeper table, and
the code length of a byte depends on its n-gram alone. It is worked out once for each n-gram that occurs anywhere, by joins
from the shortest depth up. Documents are dealt to buckets of bounded bytes; each bucket gets only the n-grams and words
that occur in it, so neither the trie nor the vocabulary must fit anywhere whole.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, session, utf8

ORDER = 4
BUCKET_BYTES = 12 << 20
#: Bytes that no UTF-8 text holds: before a text's first byte, and after its last.
BEFORE, END = 0xFE, 0xFF
PIECE = 1 << 20


def _grams(data: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end of the texts the n-gram of it and the `order` bytes before it, as a number; the text of each."""
    n = len(ends) - 1
    sizes = np.diff(ends) + 1
    owner = np.repeat(np.arange(n), sizes + order)
    starts = np.concatenate([[0], np.cumsum(sizes + order)])
    padded = np.full(starts[-1], BEFORE, np.uint8)
    inside = np.arange(len(data)) + np.repeat(starts[:-1] + order - ends[:-1], np.diff(ends))
    padded[inside] = data
    padded[starts[1:] - 1] = END
    code = np.zeros(len(padded) - order, np.int64)
    for k in range(order + 1):
        code <<= 8
        code |= padded[k : len(padded) - order + k]
    keep = np.ones(len(padded), bool)
    keep[(starts[:-1, None] + np.arange(order)).ravel()] = False
    return code[keep[order:]], owner[keep]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def _pieces(texts: pa.ChunkedArray, most: int = PIECE):
    """Bytes and offsets of runs of texts of about so many bytes, with the first text's number."""
    done = 0
    for chunk in texts.chunks:
        data, ends = utf8(chunk)
        at, n = 0, len(ends) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], done + at
            at = to
        done += n


def _count(table: pa.Table, order: int) -> pa.Table:
    """Of one bucket: every n-gram and word that occurs in it, with its occurrences in training documents."""
    train = table.column("train").to_numpy(zero_copy_only=False).astype(bool)
    words: Counter = Counter()
    seen: set = set()
    grams, counts = [], []
    for data, ends, first in _pieces(table.column("text")):
        raw = data.tobytes().lower()
        code, owner = _grams(data, ends, order)
        learnt = train[first : first + len(ends) - 1]
        value, n = _runs(code << 1 | learnt[owner])  # the lowest bit tells training from held-out occurrences
        grams.append(value >> 1)
        counts.append(n * (value & 1))
        for k, t in enumerate(learnt):
            found = raw[ends[k] : ends[k + 1]].split()
            words.update(found) if t else seen.update(found)
    grams, counts = np.concatenate([np.zeros(0, np.int64), *grams]), np.concatenate([np.zeros(0, np.int64), *counts])
    order_of = np.argsort(grams, kind="stable")
    grams, counts = grams[order_of], counts[order_of]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
    seen.difference_update(words)
    n_words = len(words) + len(seen)
    bucket = table.column("bucket")[0].as_py()
    rows = len(first) + n_words
    return pa.Table.from_arrays(
        [
            pa.array(np.full(rows, bucket, np.int32)),
            pa.concat_arrays([pa.array(grams[first]), pa.nulls(n_words, pa.int64())]),
            pa.concat_arrays([pa.nulls(len(first), pa.binary()), pa.array([*words, *seen], pa.binary())]),
            pa.concat_arrays([pa.array(sums.astype(np.int64)), pa.array([*words.values(), *[0] * len(seen)], pa.int64())]),
        ],
        names=["bucket", "gram", "word", "n"],
    )


def trie(counts: DataFrame, order: int) -> list[DataFrame]:
    """For each depth k from 0 the nodes (gram, ctx, c, n, d, e): a context and next byte as one number, the context's, its
    occurrences, all occurrences and distinct bytes after the context, and e, how often the next shorter context was followed by one of these bytes."""
    levels: list[DataFrame] = []
    deep = counts
    below = []
    for k in range(order, -1, -1):
        below.append(deep)
        if k:
            deep = deep.groupBy(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.sum("c").alias("c"))
    shorter = None
    for k, nodes in enumerate(reversed(below)):
        nodes = nodes.withColumn("ctx", F.shiftright("gram", 8))
        if shorter is not None:
            tail = shorter.select(F.col("gram").alias("tail"), F.col("c").alias("c_tail"))
            nodes = nodes.join(tail, F.col("gram").bitwiseAND((1 << 8 * k) - 1) == F.col("tail")).drop("tail")
        else:
            nodes = nodes.withColumn("c_tail", F.lit(0).cast("long"))
        stats = nodes.groupBy("ctx").agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.sum("c_tail").alias("e"))
        shorter = materialize(nodes.select("gram", "ctx", "c").join(stats, "ctx"), f"ppm-{k}")
        levels.append(shorter)
    return levels


def code_lengths(grams: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """log10 probability of each n-gram's last byte after its others, by escape and symbol exclusion.

    tail is the log probability at shorter contexts than k, given that the context of depth k excludes its bytes there. At the
    end of all stands a uniform choice among the bytes that the empty context has not seen.
    """
    order = len(levels) - 1
    ln10 = math.log(10)
    below = None
    for k in range(order + 1):
        mask = (1 << 8 * (k + 1)) - 1
        asked = grams.select(F.col("gram").bitwiseAND(mask).alias("gram")).distinct().withColumn("ctx", F.shiftright("gram", 8))
        node = levels[k]
        contexts = node.select("ctx", "n", "d", "e").distinct()
        rows = asked.join(node.select("gram", "c"), "gram", "left").join(contexts, "ctx", "left")
        if k == 0:
            # before the empty context: the bytes it has not seen
            rows = rows.withColumn("tail", -F.log(F.greatest(256 - F.coalesce("d", F.lit(0)), F.lit(1)).cast("double")))
        else:
            low = below.select(F.col("gram").alias("low"), F.col("c").alias("lc"), F.col("n").alias("ln"), F.col("d").alias("ld"), F.col("tail").alias("lt"))
            rows = rows.join(low, F.col("gram").bitwiseAND((1 << 8 * k) - 1) == F.col("low"))
            n = F.col("ln") - F.coalesce("e", F.lit(0))
            d = F.col("ld") - F.coalesce("d", F.lit(0))
            there = F.log(F.col("lc") / F.greatest(n + d, F.lit(1)))
            escape = F.when(d > 0, F.log(d / (n + d))).otherwise(F.lit(0.0)) + F.col("lt")
            rows = rows.withColumn("tail", F.when(F.col("ld").isNull(), F.col("lt")).when(F.col("lc").isNotNull(), there).otherwise(escape))
        below = rows.select("gram", "c", "n", "d", "tail")
    n, d = F.col("n"), F.col("d")
    value = F.when(d.isNull(), F.col("tail")).when(F.col("c").isNotNull(), F.log(F.col("c") / (n + d))).otherwise(F.log(d / (n + d)) + F.col("tail"))
    return below.select("gram", (value / ln10).alias("value"))


#: What a row counts for in a bucket besides its text.
ROW_BYTES = 64


def _score(docs: pa.Table, model: pa.Table, order: int, n_train: int, n_words: int) -> pa.Table:
    """Scores of one bucket's documents by the part of the model that they need."""
    import pyarrow.compute as pc

    is_gram = pc.is_valid(model.column("gram"))
    grams = model.filter(is_gram)
    gram, value = grams.column("gram").to_numpy(), grams.column("value").to_numpy()
    by = np.argsort(gram)
    gram, value = gram[by], value[by]
    words = model.filter(pc.invert(is_gram))
    known = dict(zip(words.column("word").to_pylist(), words.column("value").to_pylist(), strict=True))
    whole = n_train + 0.5 * (n_words + 1)
    n = docs.num_rows
    score, base, tokens, hits = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for data, ends, first in _pieces(docs.column("text")):
        code, owner = _grams(data, ends, order)
        both, times = _runs(owner << 8 * (order + 1) | code)
        at = np.searchsorted(gram, both & ((1 << 8 * (order + 1)) - 1))
        score[first : first + len(ends) - 1] = np.bincount(both >> 8 * (order + 1), times * value[at], len(ends) - 1)
        raw = data.tobytes().lower()
        found = [raw[ends[k] : ends[k + 1]].split() for k in range(len(ends) - 1)]
        c = np.fromiter((known.get(w, 0.0) for f in found for w in f), np.float64)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        who = np.repeat(np.arange(len(found)), sizes)
        rows = slice(first, first + len(found))
        base[rows] = np.bincount(who, np.log10((c + 0.5) / whole), len(found))
        hits[rows] = np.bincount(who, c > 0, len(found))
        tokens[rows] = sizes
    end = known.get(b" ", 0.0)  # the end's count goes by a name that no word has
    base += math.log10((end + 0.5) / whole)
    return pa.Table.from_arrays(
        [docs.column("doc_id"), pc.invert(docs.column("train")), pa.array(tokens + 1), pa.array(hits + (end > 0)), pa.array(np.full(n, n_train)), pa.array(base), pa.array(score)],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def ppm_scores(docs: DataFrame, held_out, text: str = "text", id_col: str = "doc_id", order: int = ORDER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Scores every whole text by PPM and by smoothed word frequencies, both learnt from the rows that aren't held out.

    held_out is a boolean column expression (null: held out). Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (both log10). Null and empty texts are an end alone. If nothing is learnt, bytes are uniform and no token
    is known. order is at most 4, so that an n-gram and its text fit a long. No row is dropped; equal texts get equal scores.
    """
    if not 0 <= order <= 4:
        raise ValueError("order must be 0 to 4")
    session(docs)
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (~F.coalesce(held_out, F.lit(True))).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    size = source.agg(F.sum(F.octet_length("text").cast("long") + ROW_BYTES).alias("b"), F.sum(F.col("train").cast("long")).alias("t")).first()
    buckets = max(1, -(-(size["b"] or 0) // bucket_bytes))
    dealt = source.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))

    def count(table: pa.Table) -> pa.Table:
        return _count(table, order)

    found = materialize(dealt.groupBy("bucket").applyInArrow(count, "bucket int, gram long, word binary, n long"), "ppm-found")
    grams = found.where("gram IS NOT NULL")
    levels = trie(grams.groupBy("gram").agg(F.sum("n").alias("c")).where("c > 0"), order)
    lengths = code_lengths(grams.select("gram").distinct(), levels)
    words = found.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")
    words = materialize(words, "ppm-words")
    ends = size["t"] or 0
    total = words.agg(F.sum("c").alias("c"), F.count("*").alias("v")).first()
    n_train, n_words = (total["c"] or 0) + ends, total["v"] + (1 if ends else 0)
    asked = found.where("word IS NOT NULL").select("bucket", "word").join(words, "word")
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(None).cast("long").alias("gram"), F.lit(b" ").alias("word"), F.lit(float(ends)).alias("value"))
    model = grams.select("bucket", "gram").join(lengths, "gram").select("bucket", "gram", F.lit(None).cast("binary").alias("word"), "value")
    model = model.union(asked.select("bucket", F.lit(None).cast("long"), "word", F.col("c").cast("double"))).union(every)
    model = materialize(model, "ppm-model")
    for table in [found, words, *levels]:
        drop_table(table)

    def score(docs: pa.Table, model: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return empty.empty_table()
        return _score(docs, model, order, n_train, n_words)

    empty = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return dealt.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op5_ppm(spark, sf_dir: str) -> DataFrame:
    """Every document's score by a byte model and by word frequencies, a fifth of them held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ppm_scores(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1)
