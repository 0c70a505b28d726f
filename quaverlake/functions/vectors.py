"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column, k: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * k)


def unit(v: Column) -> Column:
    """Unit length; lengths below 1e-9 divide by 1e-9."""
    return scaled(v, 1.0 / F.greatest(norm(v), F.lit(1e-9)))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def less(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def lerp(a: Column, b: Column, t: Column | float) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: (1.0 - F.lit(t)) * x + F.lit(t) * y)


def weighted_distance(a: Column, b: Column, weights: list[float]) -> Column:
    """Euclidean distance with a weight on each dimension's difference."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return norm(F.zip_with(less(a, b), w, lambda x, y: x * y))


def dimension_stats(df: DataFrame, vector: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation of each dimension, as two arrays per group."""
    parts = df.select(*keys, F.posexplode(vector).alias("d", "x"))
    stats = parts.groupBy(*keys, "d").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("d", "m", "s")))
    return stats.groupBy(*keys).agg(ordered.alias("dims")).select(*keys, F.col("dims.m").alias("mean"), F.col("dims.s").alias("std"))


def z_scored(v: Column, mean: Column, std: Column, clip: float | None = None) -> Column:
    z = F.zip_with(less(v, mean), std, lambda x, s: x / F.greatest(s, F.lit(1e-9)))
    return z if clip is None else F.transform(z, lambda x: F.least(F.greatest(x, F.lit(-clip)), F.lit(clip)))


def centroid(df: DataFrame, vector: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return dimension_stats(df, vector, keys).select(*keys, F.col("mean").alias("centroid"))
