"""Merges on keyed tables: each returns the new state of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A new row replaces the stored one as a whole; of new rows with one key the last by ``seq`` wins where there is one."""
    if "seq" in new.columns:
        latest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
        new = new.withColumn("__n", latest).where("__n = 1").drop("__n", "seq")
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def coalescing_upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A new non-null value wins, else the stored one stays; rows without any new value do nothing."""
    values = [c for c in base.columns if c != key]
    some = F.lit(False)
    for c in values:
        some = some | F.col(c).isNotNull()
    given = new.where(some).select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in values])
    joined = base.join(given, F.col(key) == F.col("__k"), "full_outer")
    return joined.select(F.coalesce(key, "__k").alias(key), *[F.coalesce(f"__{c}", c).alias(c) for c in values])


def rekey(df: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """Keys change by (``old``, ``new``); a row that already has the new key wins."""
    renamed = df.join(moves, F.col(key) == F.col("old"), "left").withColumn("__native", F.col("old").isNull()).withColumn(key, F.coalesce("new", key))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__native"), "old"))
    return renamed.withColumn("__n", first).where("__n = 1").select(df.columns)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def counted(events: DataFrame, key: str) -> DataFrame:
    """Plays, skips and the last play of each key, to be added to stored counters."""
    return events.groupBy(key).agg(
        F.count_if(F.col("event_type") == "view").alias("plays"),
        F.count_if(F.col("event_type") == "error").alias("skips"),
        F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("last_played"),
    )


def to_do(want: DataFrame, done: DataFrame, forced: DataFrame, key: str) -> DataFrame:
    """Wanted keys not done, and those named."""
    return want.join(done, key, "left_anti").unionByName(want.join(forced, key, "left_semi")).distinct()


def content_digest(df: DataFrame, order: str) -> DataFrame:
    """Rows and a digest that does not depend on their order: each row's hash, summed."""
    row = F.conv(F.substring(F.md5(F.to_json(F.struct(*df.columns))), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.select(F.col(order), row.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("digest"))
