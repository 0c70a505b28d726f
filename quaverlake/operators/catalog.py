"""Catalog queries: selections, facets, albums, folders, statistics and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def select(df: DataFrame, genres=(), artists=(), albums=(), q: str = "") -> DataFrame:
    """AND across the panes, OR within each; ``q`` is a substring of artist, album and title."""
    out = df
    if genres:
        out = out.where(F.arrays_overlap(F.transform("genres", F.lower), F.array(*[F.lit(g.lower()) for g in genres])))
    if artists:
        out = out.where(F.lower("artist").isin([a.lower() for a in artists]))
    if albums:
        out = out.where(F.lower("album").isin([a.lower() for a in albums]))
    if q:
        out = out.where(F.lower(F.concat_ws(" ", "artist", "album", "title")).contains(q.lower()))
    return out


def facets(df: DataFrame, genres=(), artists=(), albums=(), q: str = "", most: int = 4000) -> DataFrame:
    """``pane``, ``name`` and ``n``: each pane ignores its own choice."""
    panes = {
        "genre": select(df, (), artists, albums, q).select(F.explode("genres").alias("name")),
        "artist": select(df, genres, (), albums, q).select(F.col("artist").alias("name")),
        "album": select(df, genres, artists, (), q).select(F.col("album").alias("name")),
    }
    out = None
    for pane, names in panes.items():
        counted = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy("name").limit(most).select(F.lit(pane).alias("pane"), "name", "n")
        out = counted if out is None else out.unionByName(counted)
    return out


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page in order, with ``total`` and ``total_seconds`` of all rows; the totals come from an aggregate."""
    totals = df.agg(F.count(F.lit(1)).alias("total"), F.sum("seconds").alias("total_seconds"))
    return df.orderBy(*order).offset(offset).limit(max(1, min(limit, 500))).crossJoin(F.broadcast(totals))


def albums(df: DataFrame, key: list[Column]) -> DataFrame:
    """Groups of tracks: count, seconds, and the first track in pool order for the rest."""
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"), F.min("pool_i").alias("first_id"), F.min_by("title", "pool_i").alias("title")
    )


def folder_level(df: DataFrame, path: str, prefix: str) -> DataFrame:
    """Children of a folder: ``name``, rows below, and whether it is a folder."""
    below = df.where(F.startswith(F.col(path), F.lit(prefix))).select(F.substring(F.col(path), len(prefix) + 1, 1 << 20).alias("rest"))
    parts = below.select(F.substring_index("rest", "/", 1).alias("name"), F.contains("rest", F.lit("/")).alias("folder"))
    return parts.groupBy("name", "folder").agg(F.count(F.lit(1)).alias("n"))


def library_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("tracks"), F.sum("seconds").alias("seconds"), F.countDistinct(F.lower("artist")).alias("artists"),
        F.countDistinct(F.lower("album")).alias("albums"), F.count_if(F.col("seconds") > 0).alias("timed"),
    )


def status(error: Column, has_vector: Column, dimension: Column, wanted: int) -> Column:
    """Analyzed, Unanalyzable (tried and failed) or Pending."""
    failed = error.isNotNull() & (error != "")
    return F.when(has_vector & (dimension == wanted), "Analyzed").when(failed, "Unanalyzable").otherwise("Pending")


#: The named sorts of a library view.
LAST = "￿"


def named_sort(name: str) -> list[Column]:
    """Columns of a named sort: blanks and unread values last."""
    c = F.col
    blank_last = lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.lit(LAST)).otherwise(F.lower(x))
    known_first = lambda x: F.desc_nulls_last(F.nullif(c(x), F.lit(0)))
    artist, album, title = (F.lower(x) for x in ("artist", "album", "title"))
    sorts = {
        "track": [c("track_no"), title], "title": [title], "artist": [artist, album, c("track_no")], "album": [album, c("track_no")],
        "genre": [blank_last(c("genre")), artist], "length": [c("seconds")], "year": [c("year")],
        "rating": [F.desc("rating"), artist, album, c("track_no")], "plays": [F.desc("plays"), F.desc("last_played")],
        "added": [F.desc("date_added")], "status": [c("state_order"), artist], "bpm": [known_first("bpm"), artist],
        "bitrate": [known_first("bitrate"), artist], "size": [F.desc("bytes")], "filedate": [F.desc("mtime")],
        "format": [text.extension(c("path")), artist], "path": [F.lower("path")],
    }
    if name not in sorts:
        raise ValueError(f"no sort {name}")
    return [*sorts[name], c("pool_i")]


def first_by_key(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key; rows with a null key all stay."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.where(key.isNull()).unionByName(df.where(key.isNotNull()).withColumn("__n", first).where("__n = 1").drop("__n"))


def per_key(df: DataFrame, key: Column, most: int, order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def smart_view(df: DataFrame, name: str, now: int) -> DataFrame:
    views = {
        "loved": F.col("loved") == 1, "toprated": F.col("rating") >= 4, "unrated": F.col("rating") == 0, "mostplayed": F.col("plays") > 0,
        "neverplayed": F.col("plays") == 0, "recent": F.col("last_played") >= now - 30 * 86400, "missing": F.col("missing") == 1,
    }
    if name not in views:
        raise ValueError(f"no view {name}")
    return df.where(views[name])


def seed_tier(df: DataFrame, now: int, rest_days: int = 14) -> DataFrame:
    """Rows of the first non-empty tier: loved and rested, rated 4 or more, any."""
    rested = F.coalesce(F.col("last_played"), F.lit(0)) < now - rest_days * 86400
    tier = F.when((F.col("loved") == 1) & rested, 1).when(F.col("rating") >= 4, 2).otherwise(3)
    tiers = df.withColumn("tier", tier)
    return tiers.join(F.broadcast(tiers.agg(F.min("tier").alias("tier"))), "tier")
