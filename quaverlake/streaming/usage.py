"""Streams of usage events: the ledger, play counters, and plays by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

LEDGER = "kind string, at long, path string, seed string, n int"


def append_ledger(events: DataFrame, folder: str) -> None:
    """Appends events as JSON lines; ``kind`` and ``at`` (epoch seconds) are needed."""
    events.select("kind", "at", *[c for c in events.columns if c not in ("kind", "at")]).write.mode("append").json(folder)


def ledger_stream(spark: SparkSession, folder: str, schema: str | StructType = LEDGER, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def increments(events: DataFrame) -> DataFrame:
    """Per ``path``: plays, skips and the last play, of events with ``kind``, ``at`` and ``path``."""
    played = F.col("kind") == "played"
    return events.where(F.col("kind").isin("played", "skipped") & F.col("path").isNotNull()).groupBy("path").agg(
        F.count_if(played).alias("play_count"), F.count_if(~played).alias("skip_count"), F.max(F.when(played, F.col("at"))).alias("last_played")
    )


def start_counters(events: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps counters below ``folder``: each batch's increments in a folder of its own.

    A batch that runs again overwrites its folder, so nothing is counted twice, and
    the stream holds no state, however many paths there are.
    """

    def keep(batch: DataFrame, number: int) -> None:
        increments(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """The counters so far."""
    kept = spark.read.schema("path string, play_count long, skip_count long, last_played long").parquet(folder)
    return kept.groupBy("path").agg(F.sum("play_count").alias("play_count"), F.sum("skip_count").alias("skip_count"), F.max("last_played").alias("last_played"))


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """Writes the counters as one batch of another folder; the stream must not run meanwhile."""
    counters(spark, folder).write.mode("overwrite").parquet(f"{into}/batch=-1")


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Events by time window and ``keys``; those later than ``late`` behind the latest are left out."""
    groups = events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
