"""The folder that driver and executors share, and tables cut from their lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session on one machine that names none gets a temporary one, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="shared-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in it."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """A table written there and read again: computed once.  The size that joins see is that of the files, often a small part of the rows' (see ``merged``)."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def merged(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input: shuffled and sorted, never collected for a broadcast, however well their files are packed."""
    return left.join(right.hint("merge"), on, how)
