"""Queries on audio files: parts and pages written as tagged files, walked and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import containers as c
from ..operators import tags
from ..operators.shared import shared_folder
from ..sources import audio
from .registry import TRACKS, query, table, tracks


#: So many files make a task of writing, and at most a folder and so a task of reading.
FILES = 1000


def _stored(files: DataFrame, **options: str) -> DataFrame:
    """Files of ``name`` and ``content``, written to the shared folder and read back as ``audio_files``."""
    spark = files.sparkSession
    audio.register(spark)
    folder = shared_folder(spark, "audio")
    # rows pack far better than files: one task's rows can be a million files
    dealt = files.select("name", "content").repartition(max(1, -(-files.count() // FILES)), "name")
    dealt.write.format("audio_files").mode("append").save(folder)
    return spark.read.format("audio_files").options(**options).load(folder)


def _numbered(first: Column, number: Column) -> Column:
    """One of eight folders, and in it one that holds at most ``FILES`` different numbers; read with a ``depth`` of 2."""
    return F.concat(first, (number % 8).cast("string"), F.lit("/"), F.floor(number / (8 * FILES)).cast("string"), F.lit("/"))


def _pick(k: Column, choices: list[Column]) -> Column:
    out = F.when(k == 0, choices[0])
    for n, x in enumerate(choices[1:], 1):
        out = out.when(k == n, x)
    return out


def _parts(spark, sf_dir) -> DataFrame:
    year = F.concat(F.col("year").cast("string"), F.lit("-01-02"))
    return tracks(spark, sf_dir).select("id", "title", "artist", "album", "family", "seconds", year.alias("day"))


@query(f"""WITH {TRACKS}, t AS (SELECT *, id % 6 AS k FROM tracks)
SELECT id, CASE WHEN k < 4 THEN artist WHEN k = 4 THEN artist || ';' || family END AS artist,
       CASE WHEN k IN (0, 1) THEN album END AS album, CASE WHEN k = 5 THEN id::VARCHAR ELSE title END AS title,
       CASE k WHEN 0 THEN family WHEN 3 THEN family || ';' || artist END AS genre, CASE WHEN k NOT IN (2, 5) THEN year END AS year,
       CASE WHEN k IN (0, 1, 4) AND seconds > 0 THEN seconds END AS seconds
FROM t""")
def file_tags(spark, sf_dir):
    """Each part as a file of one of six kinds, one without tags and one broken off."""
    info = lambda name, col: c.chunk(name, c.raw(col))
    sound = c.chunk("data", c.raw(F.repeat(F.lit("x"), F.col("seconds").cast("int"))))
    artist, album, title, family, day = (F.col(x) for x in ("artist", "album", "title", "family", "day"))
    frames = c.id3(c.text_frame("TPE1", artist), c.text_frame("TIT2", title), c.text_frame("TDRC", day))
    listed = c.info(info("IART", family), info("IALB", album), info("IGNR", family), info("IPRD", title))
    repeated = c.info(info("IART", artist), info("IART", family), info("INAM", title), info("IPRD", album), info("ICRD", day))
    # the artist's chunk claims more bytes than the file has
    broken = F.concat(c.raw("INFO"), info("INAM", title), c.raw("IART"), c.number(5000, 4, True), c.raw(artist))
    broken = F.concat(c.raw("RIFF"), c.number(9999, 4, True), c.raw("WAVELIST"), c.number(9999, 4, True), broken)
    kinds = [
        c.wave(c.wave_format(1), c.chunk("id3 ", frames), listed, sound),
        c.wave(c.wave_format(1), sound, c.chunk("junk", c.raw(family)), repeated),
        broken,
        c.id3(c.text_frame("TPE2", artist), c.text_frame("TIT2", title), c.text_frame("TCON", family, artist), c.text_frame("TYER", day), c.frame("APIC", c.raw(title))),
        c.flac(F.col("seconds"), *[F.concat(F.lit(n), v) for n, v in (("ARTIST=", artist), ("Title=", title), ("artist=", family), ("ARTIST=", artist), ("DATE=", day))]),
        c.raw(title),
    ]
    k = F.col("id") % 6
    ending = _pick(k, [F.lit(x) for x in (".wav", ".WAV", ".wav", ".mp3", ".flac", ".mp3")])
    name = F.concat(_numbered(F.lit("d"), F.col("id")), F.lit("sub/"), F.col("id").cast("string"), ending)
    found = tags.track_fields(_stored(_parts(spark, sf_dir).select(name.alias("name"), _pick(k, kinds).alias("content")), depth="2"))
    number = F.regexp_extract("name", r"/([0-9]+)\.[^/]*$", 1).cast("long")
    return found.select(number.alias("id"), "artist", "album", "title", "genre", "year", "seconds")


MBIDS = r"regexp_replace(md5({0}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\1-\2-\3-\4-\5')"


def _mbid(text: Column) -> Column:
    return F.regexp_replace(F.md5(text), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


@query(f"""WITH {TRACKS}, t AS (SELECT *, id % 4 AS k, {MBIDS.format("title")} AS rec, {MBIDS.format("artist")} AS a, {MBIDS.format("family")} AS b FROM tracks)
SELECT id, CASE WHEN k < 2 THEN rec END AS recording_mbid, CASE k WHEN 0 THEN CASE WHEN a = b THEN a ELSE a || '; ' || b END WHEN 1 THEN a END AS artist_mbids,
       CASE WHEN k < 2 THEN year END AS original_year,
       CASE k WHEN 0 THEN family || '; ' || title WHEN 1 THEN family WHEN 2 THEN artist END AS style
FROM t WHERE k < 3""")
def file_catalog(spark, sf_dir):
    """Catalog facts of files: ids glued to other digits, years out of range and repeated styles do not count."""
    rec, first, other = (_mbid(F.col(x)) for x in ("title", "artist", "family"))
    family, title, artist, day = (F.col(x) for x in ("family", "title", "artist", "day"))
    zero = F.unhex(F.lit("00"))
    owner = lambda data: c.frame("UFID", F.concat(c.raw("http://musicbrainz.org"), zero, c.raw(data)))
    kinds = [
        c.id3(
            owner(rec), c.text_frame("TXXX", "MusicBrainz Artist Id", F.concat(first, F.lit("/"), other, F.lit("/"), first)),
            c.text_frame("TDOR", "0000"), c.text_frame("TORY", day), c.text_frame("TXXX", "STYLE", F.concat(family, F.lit(" ;"), title, F.lit("; "), family)),
        ),
        c.flac(F.col("seconds"), *[F.concat(F.lit(n), v) for n, v in (("MUSICBRAINZ_TRACKID=", F.upper(rec)), ("MUSICBRAINZ_ARTISTID=", first), ("MusicBrainz_ArtistId=", first), ("ORIGINALDATE=", F.lit("2500")), ("ORIGINALYEAR=", day), ("STYLE=", family))]),
        c.wave(c.chunk("id3 ", c.id3(owner(F.concat(rec, F.lit("0"))), c.text_frame("TXXX", "style", artist)))),
        c.id3(c.text_frame("TIT2", title)),
    ]
    k = F.col("id") % 4
    name = F.concat(_numbered(F.lit(""), F.col("id")), F.col("id").cast("string"), _pick(k, [F.lit(x) for x in (".mp3", ".flac", ".wav", ".mp3")]))
    found = tags.catalog_fields(_stored(_parts(spark, sf_dir).select(name.alias("name"), _pick(k, kinds).alias("content")), depth="2"))
    return found.select(F.regexp_extract("name", r"/([0-9]+)\.", 1).cast("long").alias("id"), "recording_mbid", "artist_mbids", "original_year", "style")


@query("""WITH f AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS bytes,
  CASE page_id % 5 WHEN 0 THEN '.mp3' WHEN 1 THEN '.Opus' WHEN 2 THEN '.txt' WHEN 3 THEN '.wav' ELSE '.mp3.jpg' END AS ending,
  CASE page_id % 7 WHEN 0 THEN 'Versioning/' WHEN 1 THEN 'Versioning2/' WHEN 2 THEN 'a/old/x/' WHEN 3 THEN 'a/older/' WHEN 4 THEN '' ELSE 'b/c/d/' END AS folder FROM pages)
SELECT folder || page_id || ending AS name, bytes FROM f WHERE page_id % 5 IN (0, 1, 3) AND page_id % 7 NOT IN (0, 2)""")
def folder_walk(spark, sf_dir):
    """Pages as files; folders that are left out are never listed, and those named like them stay."""
    ending = _pick(F.col("page_id") % 5, [F.lit(x) for x in (".mp3", ".Opus", ".txt", ".wav", ".mp3.jpg")])
    folder = _pick(F.col("page_id") % 7, [F.lit(x) for x in ("Versioning/", "Versioning2/", "a/old/x/", "a/older/", "", "b/c/d/", "b/c/d/")])
    pages = table(spark, sf_dir, "pages").select(F.concat(folder, F.col("page_id").cast("string"), ending).alias("name"), c.raw(F.coalesce("html", F.lit(""))).alias("content"))
    return _stored(pages, exclude="versioning/|A/old", tags="false", shares="2").select("name", "bytes")
