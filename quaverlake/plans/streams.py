"""Queries that run as streams over the events, up to what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lists
from ..operators.shared import shared_folder
from ..streaming import players, usage
from .registry import pool, query, table
from .similarity import seed_pool_scores


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, as a stream takes no path of a single file
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


@query("""SELECT (json_extract_string(props, '$.k'))::BIGINT::VARCHAR AS path, count(*) FILTER (WHERE event_type = 'view') AS play_count,
count(*) FILTER (WHERE event_type = 'error') AS skip_count, max(floor(epoch(ts))::BIGINT) FILTER (WHERE event_type = 'view') AS last_played
FROM events WHERE event_type IN ('view', 'error') AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1""")
def stream_play_counters(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "played").when(F.col("event_type") == "error", "skipped")
    events = event_stream(spark, sf_dir).select(kind.alias("kind"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.get_json_object("props", "$.k").alias("path"))
    folder = shared_folder(spark, "counters")
    usage.start_counters(events, folder, shared_folder(spark, "progress")).awaitTermination()
    return usage.counters(spark, folder)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n
FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def stream_hourly_counts(spark, sf_dir):
    """Hourly counts, each batch's updated windows kept under its number; the latest of a window counts."""
    counts = usage.windowed_counts(event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "30 days", "event_type")
    folder = shared_folder(spark, "hourly")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    progress = shared_folder(spark, "progress")
    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(counts.schema.add("number", "integer")).parquet(folder)
    return kept.groupBy("start", "end", "event_type").agg(F.max_by("n", "number").alias("n")).select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "event_type", "n")


#: Reports of players, made from the events: five items of a minute to four, positions in seconds.
REPORTS = """reports AS (SELECT event_id, ts, user_id AS player, k // 20 AS item, value AS "position", (60 + 45 * (k // 20))::DOUBLE AS duration
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) WHERE k IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL)"""


def reports(events: DataFrame) -> DataFrame:
    item = F.floor(F.get_json_object("props", "$.k").cast("long") / 20)
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("player"), item.alias("item"), F.col("value").alias("position"), (60 + 45 * item).alias("duration"))


@query(f"""WITH {REPORTS}, w AS (SELECT max(epoch_ms(ts)) - 3600000 AS mark FROM reports),
o AS (SELECT *, lag(item) OVER p AS before, lag(epoch_us(ts)) OVER p AS earlier FROM reports, w WHERE epoch_ms(ts) <= mark WINDOW p AS (PARTITION BY player ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN before = item AND (epoch_us(ts) - earlier) // 1000 <= 43200000 THEN 0 ELSE 1 END) OVER (PARTITION BY player ORDER BY ts, event_id) AS start FROM o),
g AS (SELECT player, item, start, min(ts) AS started, max(ts) AS last, arg_max("position", row(ts, event_id)) AS left_at, any_value(duration) AS duration, any_value(mark) AS mark,
  min(ts) FILTER ("position" >= least(duration * 0.5::DOUBLE, 240)) AS played_at, max(start) OVER (PARTITION BY player) AS newest FROM s GROUP BY player, item, start)
SELECT player, item, started, CASE WHEN played_at IS NULL THEN 'skipped' ELSE 'played' END AS kind, coalesce(played_at, last) AS "at" FROM g
WHERE played_at IS NOT NULL OR left_at > 3 AND left_at < duration * 0.33::DOUBLE AND (start < newest OR epoch_ms(last) + 43200000 < mark)""")
def stream_plays_and_skips(spark, sf_dir):
    """Plays and skips of each player, once a start, by state and timers; reports of the last hour still wait."""
    folder = shared_folder(spark, "plays")
    players.written(players.plays_and_skips(reports(event_stream(spark, sf_dir))), folder, shared_folder(spark, "progress"))
    kept = spark.read.schema(players.OUTCOME).parquet(folder)
    return kept.select("player", "item", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "at")], "kind")


@query()
def stream_radio_queues(spark, sf_dir):
    """What each event's item does to its player's radio queue, over the vectors as pool."""
    rows = pool(spark, sf_dir)
    events = event_stream(spark, sf_dir)
    items = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("id")).distinct()
    ranking = lists.ranked(seed_pool_scores(rows, rows.join(items, "id", "left_semi")))
    heads = players.radio_heads(ranking, rows.select("id", F.element_at("vector", 1).alias("energy")), 200)
    played = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("player"), F.get_json_object("props", "$.k").cast("long").alias("item"))
    folder = shared_folder(spark, "queues")
    players.written(players.radio_queues(played, heads, kind="wave"), folder, shared_folder(spark, "progress"))
    return spark.read.schema(players.QUEUE_STEP).parquet(folder)
