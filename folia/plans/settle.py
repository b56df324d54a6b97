"""Ends a long plan by writing a table."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Writes a frame to the folder that driver and executors share (spark.checkpoint.dir) and reads it back, so that later steps plan from a scan."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "folia-shared")
    path = f"{base.rstrip('/')}/folia-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
