"""Streams of documents: the row-local sources on files as they arrive.

Layout steps need whole documents, and a file is a whole document, so each micro-batch runs the batch operators as they are;
state across batches is not needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.sources import ooxml


def new_files(spark: SparkSession, folder: str, glob: str = "*.docx", files_per_batch: int = 100) -> DataFrame:
    """Files that arrive in a folder: doc_id (the path), content."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return reader.option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder).select(F.col("path").alias("doc_id"), "content")


def blocks_of_new_files(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Blocks of packages that arrive; stateless, so append mode works."""
    return ooxml.blocks(new_files(spark, folder, **options))


def convert_new_files(stream: DataFrame, convert: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that converts each micro-batch and hands it to write with the batch's number (writers can skip a batch they have)."""
    return stream.writeStream.foreachBatch(lambda batch, number: write(convert(batch), number)).option("checkpointLocation", checkpoint).start()
