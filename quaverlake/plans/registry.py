"""Queries register here with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def put(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as a pool: ``id``, ``artist`` and a double ``vector``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("artist"), F.col("embedding").cast("array<double>").alias("vector"))


POOL = "pool AS (SELECT vec_id AS id, label::VARCHAR AS artist, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tracks, with made-up tags, year, tempo and length."""
    part = table(spark, sf_dir, "part")
    words = F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))))
    return part.select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pool_i"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.concat_ws(" ", "p_brand", "p_type").alias("album"),
        words.alias("genres"), (F.col("p_size") + 1970).alias("year"), (F.floor(F.col("p_retailprice") / 10) % 120).cast("double").alias("bpm"),
        (F.floor(F.col("p_retailprice")) % 400).cast("long").alias("seconds"), F.col("p_type").alias("family"),
    )


TRACKS = """tracks AS (
  SELECT p_partkey AS id, p_partkey AS pool_i, p_name AS title, p_brand AS artist, p_brand || ' ' || p_type AS album,
         list_distinct(list_append(string_split(p_name, ' '), lower(p_type))) AS genres, p_size + 1970 AS year,
         (floor(p_retailprice / 10)::BIGINT % 120)::DOUBLE AS bpm, floor(p_retailprice)::BIGINT % 400 AS seconds, p_type AS family
  FROM part)"""


def walk_sql(before: str, size: int, spacing: int, columns: str = "seed_id, position, id, artist, score, rank") -> str:
    """SQL of a spaced walk over ``ranked`` (seed_id, rank, id, artist, score), a CTE of ``before``."""
    recent = f"arts[greatest(len(arts) - {spacing - 1}, 1):]" if spacing else "arts"
    ok = f"NOT (artist <> '' AND list_contains({recent}, artist))"
    return f"""WITH RECURSIVE {before},
walk AS (
  SELECT DISTINCT seed_id, 0::BIGINT AS r, []::BIGINT[] AS ids, []::VARCHAR[] AS arts, []::BIGINT[] AS ranks FROM ranked
  UNION ALL
  SELECT w.seed_id, w.r + 1, CASE WHEN {ok} THEN list_append(ids, x.id) ELSE ids END,
         CASE WHEN {ok} THEN list_append(arts, x.artist) ELSE arts END,
         CASE WHEN {ok} THEN list_append(ranks, x.rank) ELSE ranks END
  FROM walk w JOIN ranked x ON x.seed_id = w.seed_id AND x.rank = w.r + 1 WHERE len(ids) < {size}),
last AS (SELECT seed_id, arg_max(ranks, r) AS ranks FROM walk GROUP BY seed_id),
listed AS (SELECT seed_id, unnest(ranks) AS rank, unnest(range(1, len(ranks) + 1)) AS position FROM last)
SELECT {columns} FROM (
  SELECT l.seed_id, l.position::INT AS position, x.id, x.artist, x.score, l.rank::INT AS rank FROM listed l JOIN ranked x ON x.seed_id = l.seed_id AND x.rank = l.rank)"""
