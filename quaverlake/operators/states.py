"""What is stored, fresh, failed or still to do, by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How the reasons of failures begin that another attempt may cure.
NEEDS_DECODER = "no decoder:"
TOO_SHORT = ("too short", "short read")


def up_to_date(features: DataFrame, tracks: DataFrame) -> DataFrame:
    """Paths with a vector or an error whose file has not changed since, as far as is known."""
    both = features.join(tracks.select("path", "mtime"), "path")
    tried = F.col("vec").isNotNull() | F.col("error").isNotNull()
    same = F.col("src_mtime").isNull() | F.col("mtime").isNull() | (F.col("src_mtime") == F.col("mtime"))
    return both.where(tried & same).select("path")


def to_retry(features: DataFrame, decoder: bool, everything: bool = False) -> DataFrame:
    """Failed paths worth another attempt, with the reason."""
    failed = features.where(F.col("error").isNotNull())
    if everything:
        return failed.select("path", F.lit("all failed").alias("why"))
    short = F.lit(False)
    for prefix in TOO_SHORT:
        short = short | F.col("error").startswith(prefix)
    why = F.when(F.col("error").startswith(NEEDS_DECODER), "decoder now present").when(short, "second decoder now asked")
    return failed.withColumn("why", why).where(F.col("why").isNotNull() & F.lit(decoder)).select("path", "why")


def to_measure(tracks: DataFrame, measured: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Tracks without a measurement of their present file, and failed ones on request."""
    known = measured.select("path", "src_mtime", F.col("error").alias("failed"), F.lit(True).alias("known"))
    joined = tracks.select("path", "mtime").join(known, "path", "left")
    fresh = F.col("known") & F.col("src_mtime").eqNullSafe(F.col("mtime"))
    again = F.lit(retry_errors) & F.col("failed").isNotNull()
    return joined.where(~F.coalesce(fresh, F.lit(False)) | again).select("path", "mtime")


def cleared(vectors: DataFrame, only_failed: bool) -> DataFrame:
    """The vectors that stay when failed ones, or all, are cleared."""
    return vectors.where(F.col("error").isNull()) if only_failed else vectors.limit(0)


def present(pool: DataFrame, files: DataFrame) -> DataFrame:
    """The pool without files that a check has found missing."""
    return pool.join(files.where(F.col("missing") == 1), "path", "left_anti")


def backfilled(df: DataFrame, column: str, other: str) -> DataFrame:
    """``column`` taken from ``other`` where it was never set."""
    return df.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit(0)), F.col(other)))


def descriptor_ok(vector: Column, size: int) -> Column:
    """Whether a descriptor has the stated size and finite values only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def provenance(path: Column) -> Column:
    """Lists that a similarity engine wrote, by their names; others are curated or unknown."""
    name = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    base = F.substring_index(name, "/", -1)
    machine = base.startswith("like-") | F.contains(base, F.lit("-like-")) | name.startswith("_similar to/")
    return F.when(machine, "machine_similarity").otherwise("curated_or_unknown")


#: Parts of album names that stand for no album.
PLACEHOLDERS = ("singles & loose tracks", "loose tracks", "b-sides", "b sides", "bootleg", "unknown album", "various artists", "compilation")


def is_placeholder(album: Column) -> Column:
    return F.exists(F.array(*map(F.lit, PLACEHOLDERS)), lambda p: F.contains(F.lower(album), p))


def outside_subtree(path: Column, excluded: list[str]) -> Column:
    """Whether a path lies in none of the excluded folders; a sibling whose name begins alike does not count."""
    norm = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    inside = F.lit(False)
    for folder in excluded:
        root = folder.replace("\\", "/").rstrip("/").lower()
        inside = inside | (norm == root) | norm.startswith(root + "/")
    return ~inside
