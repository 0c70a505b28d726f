"""Imports of add-on tables and catalogs from CSV, JSON and key-value records.

Where a key recurs, its last row stays; rows without a key are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named columns as strings; a column that the file lacks is null."""
    found = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    return found.select(*[F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in columns])


def _last(df: DataFrame, *keys: str) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    rows = df.withColumn("__at", F.monotonically_increasing_id())
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "__at").alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others])


def _given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and ``family``, trimmed."""
    trimmed = _csv(spark, path, ["value", "family"]).select(F.trim("value").alias("value"), F.trim("family").alias("family"))
    return _last(trimmed.where("value <> '' AND family <> ''"), "value")


def read_catalog_ids(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path, ["path", "recording_mbid", "artist_mbids", "original_year", "style"]).where("path <> ''")
    year = F.col("original_year").try_cast("int").alias("original_year")
    return _last(rows.select("path", _given("recording_mbid").alias("recording_mbid"), _given("artist_mbids").alias("artist_mbids"), year, _given("style").alias("style")), "path")


def read_artist_similarity(spark: SparkSession, path: str) -> DataFrame:
    """A score that is no number fails the import."""
    rows = _csv(spark, path, ["artist_mbid", "similar_mbid", "source", "score"]).where("artist_mbid <> '' AND similar_mbid <> ''")
    return _last(rows.withColumn("score", F.col("score").cast("double")), "artist_mbid", "similar_mbid", "source")


def read_catalog_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Tracks of a catalog file: an array of objects, or one object a line (which Spark can split)."""
    schema = "file string, artist string, album string, name string, genre string, year int, seconds int, bytes long, modified long"
    rows = spark.read.schema(schema).json(path, multiLine=multi_line).where("file <> ''")
    return _last(rows.withColumnsRenamed({"file": "path", "name": "title", "modified": "mtime"}), "path")


def read_records(spark: SparkSession, path: str, fields: list[str], numbers: tuple[str, ...] = ("seconds", "year", "bytes"), separator: str = "\n\n") -> DataFrame:
    """Records of lines "key value", parted by an empty line; of a repeated key the last value counts.

    ``numbers`` are longs, null where they are no number; absent keys are null.
    """
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda s: F.regexp_replace(s, r"\r$", "")), lambda s: F.trim(s) != "")
    records = spark.read.text(path, lineSep=separator).select(lines.alias("lines")).where(F.size("lines") > 0)

    def field(name: str) -> Column:
        mine = F.filter("lines", lambda s: F.substring_index(s, " ", 1) == name)
        value = F.substring(F.try_element_at(mine, F.lit(-1)), len(name) + 2, 1 << 30)
        return (value.try_cast("long") if name in numbers else value).alias(name)

    return records.select(*map(field, fields))
