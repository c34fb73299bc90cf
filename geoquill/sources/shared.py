"""Folders that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; on one machine, where that is unset, a local one. A cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "geoquill-shared")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to a shared folder and read from there: a long plan ends, and lost executors cost nothing."""
    path = folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
