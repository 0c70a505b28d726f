"""The fields of tracks and of the catalog, chosen from the raw tags of audio files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names under which each field is stored, first choice first.
FIELDS = {
    "artist": ("artist", "TPE1", "Author", "\xa9ART"),
    "albumartist": ("albumartist", "album_artist", "album artist", "TPE2", "WM/AlbumArtist", "aART"),
    "album": ("album", "TALB", "WM/AlbumTitle", "\xa9alb"),
    "title": ("title", "TIT2", "\xa9nam"),
    "genre": ("genre", "TCON", "WM/Genre", "\xa9gen"),
    "date": ("date", "year", "originaldate", "TDRC", "TDRL", "TYER", "TDOR", "WM/Year", "\xa9day"),
}
# The names of RIFF lists.
INFO = {"artist": ("IART",), "title": ("INAM",), "album": ("IPRD", "IALB"), "genre": ("IGNR",), "date": ("ICRD", "IYER")}
# The names of catalog facts, first choice first.
CATALOG = {
    "recording_mbid": ("ufid:http://musicbrainz.org", "musicbrainz_trackid", "musicbrainz track id", "----:com.apple.itunes:musicbrainz track id", "musicbrainz/track id"),
    "artist_mbids": ("txxx:musicbrainz artist id", "musicbrainz_artistid", "musicbrainz artist id", "----:com.apple.itunes:musicbrainz artist id", "musicbrainz/artist id"),
    "original_year": (
        "tdor", "originaldate", "----:com.apple.itunes:originaldate", "wm/originalreleasetime", "tory", "originalyear", "txxx:originalyear",
        "----:com.apple.itunes:originalyear", "----:com.apple.itunes:original year", "wm/originalreleaseyear", "origyear", "----:com.apple.itunes:origyear",
    ),
    "style": ("txxx:style", "style", "----:com.apple.itunes:style"),
}
#: The years that a release can have.
YEARS = (1000, 2100)
MBID = r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])"


def _values(tags: str, name: str) -> Column:
    """The distinct values stored under a name, in any case, in the order of the file."""
    mine = F.filter(tags, lambda t: F.lower(t["name"]) == name.lower())
    return F.array_distinct(F.transform(mine, lambda t: t["value"]))


def _first(tags: str, names: tuple[str, ...]) -> Column:
    """The values under the first name that has any."""
    found = [_values(tags, n) for n in names]
    return F.coalesce(*[F.when(F.size(v) > 0, v) for v in found], F.array().cast("array<string>"))


def _joined(values: Column) -> Column:
    return F.nullif(F.array_join(values, ";"), F.lit(""))


def track_fields(files: DataFrame) -> DataFrame:
    """Artist (else album artist), album, title (else the file's name), genre, year and seconds of each file.

    Several values are joined by ``;``.  The INFO list of a wave file fills what its other tags
    leave open; of a name that recurs there the first value counts.  The year is the first four
    characters of the date where these are digits.
    """
    wav = F.lower(F.col("name")).endswith(".wav")

    def field(name: str) -> Column:
        # an INFO list knows one value a field, under whichever of its names comes first in the file
        listed = F.filter("info", lambda t: t["name"].isin(*INFO[name])) if name in INFO else None
        filled = F.when(wav, F.try_element_at(listed, F.lit(1))["value"]) if name in INFO else F.lit(None)
        return F.coalesce(_joined(_first("tags", FIELDS[name])), filled)

    base = F.substring_index("name", "/", -1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    year = F.regexp_extract(field("date"), r"\A([0-9]{4})", 1).try_cast("int")
    return files.select(
        "path", "name", F.coalesce(field("artist"), field("albumartist")).alias("artist"), field("album").alias("album"),
        F.coalesce(field("title"), stem).alias("title"), field("genre").alias("genre"), year.alias("year"), "seconds", "bytes", "mtime",
    )


def catalog_fields(files: DataFrame) -> DataFrame:
    """Recording, artists, year of first release and styles, of the files that have any of them.

    Ids count where they stand on their own and come in lower case.  The year is the first one
    within ``YEARS`` under any of its names, so that a damaged value hides no good one.
    """
    ids = lambda name: F.transform(F.regexp_extract_all(F.array_join(_first("tags", CATALOG[name]), " "), F.lit(MBID), 0), F.lower)
    dates = F.flatten(F.array(*[_values("tags", n) for n in CATALOG["original_year"]]))
    # RLIKE with \A and four ASCII digits: other digits of Unicode are no year
    years = F.transform(F.filter(dates, lambda v: v.rlike(r"\A[0-9]{4}")), lambda v: F.substring(v, 1, 4).cast("int"))
    year = F.try_element_at(F.filter(years, lambda y: y.between(*YEARS)), F.lit(1))
    parts = F.transform(F.flatten(F.transform(_first("tags", CATALOG["style"]), lambda v: F.split(v, ";"))), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    listed = lambda a: F.nullif(F.array_join(F.array_distinct(a), "; "), F.lit(""))
    rows = files.select(
        "path", "name", F.try_element_at(ids("recording_mbid"), F.lit(1)).alias("recording_mbid"), listed(ids("artist_mbids")).alias("artist_mbids"),
        year.alias("original_year"), listed(F.filter(parts, lambda s: s != "")).alias("style"),
    )
    return rows.where("coalesce(recording_mbid, artist_mbids, cast(original_year AS STRING), style) IS NOT NULL")
