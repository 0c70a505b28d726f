"""Playlist files as rows, and rows as playlist files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

URL = r"(?i)^(https?|mms|rtsp)://"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _western(content: Column) -> Column:
    """Bytes of a Western code page; those it does not define make the whole file Latin-1."""
    latin = F.decode(content, "ISO-8859-1")
    defined = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
    undefined = "".join(chr(b) for b in range(0x80, 0xA0) if b not in defined)
    swapped = F.translate(latin, "".join(map(chr, defined)), bytes(defined).decode("cp1252"))
    return F.when(latin.rlike(f"[{undefined}]"), latin).otherwise(swapped)


def read_playlists(spark: SparkSession, folder: str, depth_glob: str = "*.m3u*") -> DataFrame:
    """Lines of playlist files: ``playlist``, ``position`` among its entries, ``kind`` and ``entry``.

    ``kind`` is ``entry``, ``url`` or ``comment`` (no position); blank lines and byte
    order marks are dropped.  A file that is no UTF-8 is read as a Western code page.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", depth_glob).option("recursiveFileLookup", True).load(folder)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), _western(F.col("content")))
    lines = F.filter(F.transform(F.split(text, LINE_END), lambda s: F.regexp_replace(s, r"^[\s\uFEFF]+|\s+$", "")), lambda s: s != "")
    kind = F.when(F.col("entry").startswith("#"), "comment").when(F.col("entry").rlike(URL), "url").otherwise("entry")
    rows = files.select(F.col("path").alias("playlist"), F.posexplode(lines).alias("line", "entry")).withColumn("kind", kind)
    of_kind = Window.partitionBy("playlist", "kind").orderBy("line")
    return rows.select("playlist", F.when(F.col("kind") == "entry", F.row_number().over(of_kind)).alias("position"), "kind", "entry")


def m3u8_lines(rows: DataFrame) -> DataFrame:
    """``playlist``, ``line_no`` and ``value``: the header, then two lines per row in order of ``position``.

    Needs ``playlist``, ``position``, ``path``, ``artist``, ``title`` and ``seconds``;
    line ends in tags become spaces; unknown seconds are -1.
    """
    one_line = lambda c: F.regexp_replace(c, r"[\r\n]", " ")
    filled = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    name = F.substring_index("path", "/", -1)
    seconds = F.when(F.col("seconds") != 0, F.col("seconds").cast("int"))
    info = F.concat(F.lit("#EXTINF:"), F.coalesce(seconds, F.lit(-1)).cast("string"), F.lit(","), one_line(filled("artist", F.lit("?"))), F.lit(" - "), one_line(filled("title", name)))
    place = F.row_number().over(Window.partitionBy("playlist").orderBy("position", "path", "seconds", "artist", "title"))
    both = F.array(info, F.col("path"))
    lines = rows.withColumn("__n", place).select("playlist", "__n", F.when(F.col("__n") == 1, F.concat(F.array(F.lit("#EXTM3U")), both)).otherwise(both).alias("__lines"))
    first = F.when(F.col("__n") == 1, 0).otherwise(2 * F.col("__n") - 1)
    return lines.select("playlist", first.alias("__first"), F.posexplode("__lines").alias("__k", "value")).select("playlist", (F.col("__first") + F.col("__k")).alias("line_no"), "value")


def write_m3u8(rows: DataFrame, folder: str) -> None:
    """One text file per playlist, below ``folder/playlist=<name>``; the lines stay in order."""
    m3u8_lines(rows).sortWithinPartitions("playlist", "line_no").drop("line_no").write.partitionBy("playlist").mode("overwrite").text(folder)
