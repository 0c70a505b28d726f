"""Queries on the written forms of lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import playlists
from .registry import TRACKS, query, table, tracks


@query(f"""WITH {TRACKS},
listed AS (SELECT l_orderkey AS playlist, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, artist || '/' || title || '.mp3', seconds) AS n, artist, title, seconds, artist || '/' || title || '.mp3' AS path
  FROM lineitem JOIN tracks ON id = l_partkey)
SELECT playlist, 0 AS line_no, '#EXTM3U' AS value FROM listed WHERE n = 1
UNION ALL SELECT playlist, (2 * n - 1)::INT, '#EXTINF:' || CASE WHEN seconds = 0 THEN -1 ELSE seconds END || ',' || artist || ' - ' || title FROM listed
UNION ALL SELECT playlist, (2 * n)::INT, path FROM listed""")
def playlist_lines(spark, sf_dir):
    """Each order as a playlist of its parts."""
    parts = tracks(spark, sf_dir).select("id", "artist", "title", "seconds", F.concat("artist", F.lit("/"), "title", F.lit(".mp3")).alias("path"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("playlist"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("id"))
    return playlists.m3u8_lines(lines.join(parts, "id"))
