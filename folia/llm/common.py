"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that go to a Python worker at once; bounds its memory whatever the texts' lengths.
BATCH_BYTES = 8 << 20
#: Bits of the map that marked() broadcasts: 2 MB, whatever the number of ids.
PLACES = 1 << 24


def session(df: DataFrame) -> SparkSession:
    """The frame's session, set to hand Arrow batches of bounded bytes to Python."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder's name under the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir; only on one machine a local one serves where that is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "folia-shared")
    return f"{base.rstrip('/')}/folia-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, key: str) -> DataFrame:
    """As materialize(), as a table in buckets of a key's hash, so that joins on the key shuffle only what meets it."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.bucket_table = name
    return out


def drop_table(df: DataFrame) -> None:
    """Removes the files of a frame made by materialize() or bucketed()."""
    spark = df.sparkSession
    name = getattr(df, "bucket_table", None)
    if name:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        spark.sql(f"DROP TABLE {name}")
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def marked(df: DataFrame, value: str, ids: DataFrame, to: str) -> DataFrame:
    """Adds whether a row's value (long) may be among ids, a frame of one column of longs: true for all that are, and for a few others.

    The ids' hashes set bits of a map of bounded size, which is broadcast, so rows that can be told apart by it need no shuffle; an exact
    join decides on those that are marked. Many more ids than PLACES mark every row, which costs that join its whole input and no result.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(PLACES))
    word, bit = lambda c: F.shiftright(place(c), 6), lambda c: F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(`{c}`), 64) AS INT))")
    name = ids.columns[0]
    words = ids.groupBy(word(name).alias("place word")).agg(F.bit_or(bit(name)).alias("place bits"))
    hit = F.coalesce(F.col("place bits").bitwiseAND(bit(value)) != 0, F.lit(False))
    return df.join(F.broadcast(words), word(value) == F.col("place word"), "left").withColumn(to, hit).drop("place word", "place bits")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, end to end, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def lower_ascii(text: str):
    """A column of texts with A-Z lowered, in which no other letter has turned into an ASCII one."""
    column = F.coalesce(F.col(text), F.lit(""))
    return F.lower(F.replace(F.replace(column, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı")))
