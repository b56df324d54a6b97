"""Packing by optimal length buckets.

The histogram of all lengths, in steps of GRAIN, is aggregated first; dynamic programming over it finds the bucket bounds
that waste least padding (the cost is a Monge array, so each row's best split moves one way and halving finds all of them).
Inside a bucket, documents in order of id fill batches of a token budget. Ranks inside buckets come from counts of range
partitions, so no bucket is ever in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, session

GRAIN, BUCKETS, BUDGET = 8, 16, 1 << 16


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Upper bounds of at most so many buckets for distinct ascending lengths, and the least padding: each document is padded to its bucket's bound."""
    n = len(lengths)
    if not n:
        return [], 0
    many = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    mass = np.concatenate([[0], np.cumsum(lengths * counts)]).astype(np.float64)
    buckets = min(buckets, n)
    best = lengths * many[1:] - mass[1:]  # one bucket for the first i + 1 lengths
    splits = []

    def layer(before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        out, at = np.full(n, np.inf), np.zeros(n, np.int64)
        todo = [(k, n - 1, k, n - 1)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            j = np.arange(left, min(mid, right) + 1)  # the last bucket begins with length j
            cost = before[j - 1] + lengths[mid] * (many[mid + 1] - many[j]) - (mass[mid + 1] - mass[j])
            c = int(cost.argmin())
            out[mid], at[mid] = cost[c], j[c]
            todo += [(lo, mid - 1, left, int(j[c])), (mid + 1, hi, int(j[c]), right)]
        return out, at

    for k in range(1, buckets):
        best, at = layer(best, k)
        splits.append(at)
    out, end = [], n - 1
    for at in reversed(splits):
        out.append(int(lengths[end]))
        end = int(at[end]) - 1
    out.append(int(lengths[end]))
    return out[::-1], int(best[n - 1])


def word_count(text: str):
    """Words between ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]++"))


def pack(docs: DataFrame, length=None, text: str = "text", id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET, grain: int = GRAIN) -> DataFrame:
    """Deals every document to a length bucket and a batch.

    length is a column expression (words of the text and an end by default); lengths under 1 count as 1. Returns doc_id,
    n_tokens, bucket (from 0), padded (the bucket's bound: its longest document, in steps of grain), batch (from 0 inside the
    bucket), slot (inside the batch). A batch holds floor(budget / padded) documents, one at least. Ids ascend over a bucket's batches, null first;
    rows that share an id take adjacent slots by length. Empty tables give no rows. Distinct lengths in steps of grain are
    aggregated to the driver: one row for each step up to the longest document.
    """
    session(docs)
    length = word_count(text) + 1 if length is None else length
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("long").alias("n_tokens"))
    sized = materialize(sized.withColumn("step", F.ceil(F.col("n_tokens") / grain).cast("long")), "pack-sizes")
    histogram = sorted(sized.groupBy("step").count().collect())
    ends, _ = bounds(np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64), buckets)
    edges = np.array(ends, np.int64)
    # a search in constants: the number of bounds below a length
    bucket = F.lit(0)
    for e in ends[:-1]:
        bucket = bucket + (F.col("step") > e).cast("int")
    padded = F.get(F.array(*[F.lit(int(e) * grain) for e in ends]) if ends else F.array(F.lit(grain)), F.col("bucket")).cast("long")
    dealt = sized.withColumn("bucket", bucket).withColumn("padded", padded).select("doc_id", "n_tokens", "bucket", "padded")
    ordered = dealt.repartitionByRange("bucket", F.asc_nulls_first("doc_id"), "n_tokens").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "n_tokens")

    def number(batches):
        """The place of each row among its partition's rows of the bucket."""
        part, done = TaskContext.get().partitionId(), np.zeros(max(1, len(edges)), np.int64)
        for b in batches:
            k = b.column("bucket").to_numpy()
            n = np.bincount(k, minlength=len(done))
            first = np.cumsum(n) - n  # rows are sorted by bucket
            place = done[k] + np.arange(len(k)) - first[k]
            done += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(k), part, np.int32)), pa.array(place)], names=[*b.schema.names, "part", "place"])

    numbered = materialize(ordered.mapInArrow(number, "doc_id long, n_tokens long, bucket int, padded long, part int, place long"), "pack-numbered")
    drop_table(sized)
    # rows of a bucket in earlier partitions: a bucket has a row for each partition that it reaches
    counts = numbered.groupBy("bucket", "part").agg(F.count("*").alias("n")).orderBy("bucket", "part").collect()
    before, total, last = [], 0, None
    for r in counts:
        total = total if r["bucket"] == last else 0
        before.append((r["bucket"], r["part"], total))
        total, last = total + r["n"], r["bucket"]
    starts = docs.sparkSession.createDataFrame(before, "bucket int, part int, before long")
    rank = F.col("before") + F.col("place")
    room = F.greatest(F.lit(budget) / F.col("padded"), F.lit(1)).cast("long")
    return numbered.join(F.broadcast(starts), ["bucket", "part"]).select(
        "doc_id", "n_tokens", "bucket", "padded", F.floor(rank / room).cast("long").alias("batch"), (rank % room).cast("long").alias("slot")
    )


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
