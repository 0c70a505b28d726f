"""Ranks and percentiles of whole pools without a window over a pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept


def percentiles(df: DataFrame, values: list[str], group: str = "seed_id", key: str = "id") -> DataFrame:
    """``group``, ``key`` and of each value's column its percentile within the group, ties averaged; 0.5 in a group of one.

    Values are counted where they lie and dealt by range.  Each range sums its counts up
    in order, and the totals of the ranges before it, one row a range and column, come
    in by a join; so no task sees a pool, but the rows of one range.  Null values have a
    null percentile and count for nothing.  (``group``, ``key``) must be unique.
    """
    long = df.select(group, key, F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values])).alias("x")).select(group, key, "x.*").where("value IS NOT NULL")
    counts = long.groupBy(group, "name", "value").agg(F.count(F.lit(1)).alias("tied"))
    # a named range of each row is what the sums below go by, so it is kept with the rows
    ranged = kept(counts.repartitionByRange(F.col(group), F.col("name"), F.col("value")).withColumn("range", F.spark_partition_id()), "value-counts")
    inner = Window.partitionBy(group, "name", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(group, "name", "range").agg(F.sum("tied").alias("total"))
    outer = Window.partitionBy(group, "name")
    ahead = totals.withColumn("ahead", F.coalesce(F.sum("total").over(outer.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("total").over(outer)).drop("total")
    below = F.coalesce(F.sum("tied").over(inner), F.lit(0)) + F.col("ahead")
    placed = ranged.join(ahead, [group, "name", "range"]).select(group, "name", "value", F.when(F.col("n") < 2, 0.5).otherwise((below + (F.col("tied") - 1) / 2) / (F.col("n") - 1)).alias("percentile"))
    found = long.join(placed, [group, "name", "value"])
    return found.groupBy(group, key).agg(*[F.max(F.when(F.col("name") == v, F.col("percentile"))).alias(v) for v in values])


def sorted_page(df: DataFrame, value: str, offset: int, limit: int, key: str = "id") -> DataFrame:
    """A page of rows by percentile of a column, the highest first, equal ones by key; rows without a value come last."""
    ranked = df.select(F.lit(0).alias("one"), key, value)
    place = percentiles(ranked, [value], "one", key).select(key, F.col(value).alias("percentile"))
    order = [F.desc_nulls_last("percentile"), F.asc(key)]
    head = ranked.select(key, value).join(place, key, "left").orderBy(*order).limit(offset + limit)
    numbered = head.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # a page's few rows
    return numbered.where(F.col("position") > offset)
