"""A corpus pipeline: toxic documents go, later copies of repeated line runs go, one document of each near-duplicate group stays, the rest is packed.

Each stage is a function of (session, documents, folder of the tables). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm import crf, minhash, packing, suffix
from folia.llm.common import marked, materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects (score 0.5 or more); it learns from labels outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = crf.fit(*crf.labelled_sample(docs, labels, ~crf.held_out()))
    return crf.tag(docs, model, to="toxicity verdict").where(F.col("toxicity verdict.predicted") == 0).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of repeated line runs; a document of which nothing is left goes, as all of it stands elsewhere. n_chars follows the text."""
    out = suffix.dedup_lines(docs, to="dead lines")
    out = out.where((F.size("dead lines") == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("dead lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the one with the least id."""
    removed = minhash.near_duplicates(docs, shingle=5).where(~F.col("kept")).select(F.col("doc_id").alias("removed id")).distinct()
    own = marked(docs.withColumn("own id", F.col("doc_id").cast("long")), "own id", removed, "maybe removed")
    # only texts that are marked are shuffled, to be held against the ids themselves
    kept = own.where("`maybe removed`").join(removed.hint("merge"), F.col("own id") == F.col("removed id"), "left_anti")
    return own.where("NOT `maybe removed`").unionByName(kept).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("minhash near-dedup", near_dedup), ("packing", pack)]

#: Fitted weights, shortest paths and dynamic programming are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
