"""Text keys, tags and small conversions."""

from __future__ import annotations

from unicodedata import combining, normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that name a kind of recording, not a genre.
THEMES = ("covers", "cover")
#: Title suffixes of other takes of a song.
TAKES = (
    r"\s*-\s*(live|remaster(ed)?|mono|stereo|single version|album version|previously unreleased|alternate take|alt\.? take"
    r"|demo|edit|radio edit|acoustic|instrumental|take \d+)\b.*$"
)
BRACKETED = r"\(.*?\)|\[.*?\]"


def tags(genre: Column) -> Column:
    """Scoring tags: split at ; and comma, trimmed, lower case, distinct."""
    parts = F.transform(F.split(F.coalesce(genre, F.lit("")), "[;,]"), lambda t: F.lower(F.trim(t)))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def listed_genres(genre: Column) -> Column:
    """Facet genres: split at ; only, case and repeats kept."""
    parts = F.transform(F.split(F.coalesce(genre, F.lit("")), ";"), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def slash_tags(genre: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(genre, F.lit("")), "[/,]"), lambda t: F.lower(F.trim(t)))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def primary_genre(genre: Column) -> Column:
    first = F.trim(F.substring_index(F.substring_index(F.coalesce(genre, F.lit("")), ",", 1), ";", 1))
    return F.when(first == "", F.lit("?")).otherwise(first)


def with_style(genre_tags: Column, style_tags: Column) -> Column:
    return F.array_except(F.array_union(genre_tags, style_tags), F.array(*map(F.lit, THEMES)))


def jaccard(a: Column, b: Column) -> Column:
    """0 where either side is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def family_credit(closeness: Column, same_family: Column, credit: float) -> Column:
    return closeness + F.lit(credit) * (1.0 - closeness) * F.when(same_family, 1.0).otherwise(0.0)


def _plain_letters() -> tuple[str, str]:
    """Latin letters with accents, and each without; and quotes that stand for the plain ones."""
    pairs = [(chr(c), normalize("NFKD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(normalize("NFKD", chr(c))) > 1]
    pairs = [(c, p) for c, p in pairs if p.isascii() and p.isalpha() and all(map(combining, normalize("NFKD", c)[1:]))]
    quotes = [(c, "'") for c in "\u2018\u2019"] + [(c, '"') for c in "\u201c\u201d"]
    return tuple("".join(x) for x in zip(*(pairs + quotes), strict=True))


PLAIN_LETTERS = _plain_letters()


def folded(text: Column) -> Column:
    """Lower case, Latin letters without accents; null is empty.  Other scripts keep their marks."""
    t = F.translate(F.coalesce(text, F.lit("")), *PLAIN_LETTERS)
    return F.lower(F.regexp_replace(t, "[\u0300-\u036f]", ""))


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def match_key(text: Column, fold=folded) -> Column:
    """Comparable title or artist: ``&`` spelled out, guests, brackets, punctuation and a leading article dropped."""
    t = F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "&", " and ")
    t = F.regexp_replace(t, r"\b(feat|ft|featuring|with)\b.*$", " ")
    t = _squeezed(F.regexp_replace(t, BRACKETED, " "))
    return F.trim(F.regexp_replace(t, r"^(the|a|an)\s+", ""))


def loose_key(text: Column) -> Column:
    return F.regexp_replace(match_key(text), " ", "")


def twin_key(artist: Column, title: Column) -> Column:
    """Artist and title as one key, without takes and brackets; null where no title is left."""
    t = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[\(\[].*?[\)\]]", "")
    t = _squeezed(F.regexp_replace(t, TAKES, ""))
    return F.when(t != "", F.concat_ws("|", _squeezed(F.lower(F.coalesce(artist, F.lit("")))), t))


def tail_key(path: Column, parts: int = 3) -> Column:
    """The last components of a path, lower case, whichever separator it has."""
    split = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p != "")
    return F.lower(F.array_join(F.slice(split, F.greatest(F.size(split) - parts + 1, F.lit(1)), parts), "/"))


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/[^/]*$", "")


def extension(path: Column) -> Column:
    return F.upper(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def duplicate_key(kind: str, artist: Column, title: Column, path: Column) -> Column:
    """The key of one of the de-duplication rules: song, title or file."""
    if kind == "song":
        return F.concat_ws("|", F.lower(F.trim(artist)), F.lower(F.trim(title)))
    return F.lower(F.trim(title)) if kind == "title" else F.lower(basename(path))


def clock(seconds: Column) -> Column:
    s = F.coalesce(seconds, F.lit(0)).cast("int")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60)))


def track_number(name: Column) -> Column:
    n = F.regexp_extract(name, r"^\s*(\d{1,3})", 1)
    return F.when(n == "", 0).otherwise(n.cast("int"))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


#: Names that some file systems keep for devices.
DEVICES = ("CON", "PRN", "AUX", "NUL", *(f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10)))


def safe_component(name: Column, other: str = "") -> Column:
    """A name that file systems with few allowed characters take; ``other`` where nothing is left."""
    t = F.regexp_replace(F.coalesce(name, F.lit("")), r"[ \t\n\r\f\x0b]+", " ")
    t = F.trim(F.regexp_replace(t, r'[<>:"/\\|?*\x00-\x1f]', "_"))
    t = F.btrim(F.substring(F.btrim(t, F.lit(". ")), 1, 120), F.lit(". "))
    stem = F.upper(F.regexp_replace(t, r"\.[^.]*$", ""))
    return F.when(t == "", F.lit(other)).when(stem.isin(*DEVICES), F.concat(F.lit("_"), t)).otherwise(t)


def title_of(template: Column, when: Column, extra: dict[str, Column] | None = None) -> Column:
    """A playlist name: {date}, {ymd}, {year}, {month} and ``extra`` tokens expanded, unknown ones left; edges trimmed."""
    dates = {"date": F.date_format(when, "yy-MM-dd"), "ymd": F.date_format(when, "yyyy-MM-dd"), "year": F.date_format(when, "yyyy"), "month": F.date_format(when, "MMMM")}
    for token, value in (dates | (extra or {})).items():
        template = F.replace(template, F.lit("{" + token + "}"), value.cast("string"))
    return F.trim(template)


NUMBER = r"(-?inf|nan|-?\d+(?:\.\d+)?)"


def loudness_summary(report: Column) -> Column:
    """Integrated loudness, range and true peak of the last summary of a loudness report; not finite is null."""
    tail = F.when(F.contains(report, F.lit("Summary:")), F.substring_index(report, "Summary:", -1))

    def figure(label: str, name: str, unit: str) -> Column:
        found = F.regexp_extract(tail, rf"{label}:\s*\n\s*{name}:\s*{NUMBER}\s*{unit}", 1)
        return F.when(found.rlike(r"^-?\d"), found.cast("double"))

    lufs = F.regexp_extract(tail, rf"Integrated loudness:\s*\n\s*I:\s*{NUMBER}\s*LUFS", 1)
    parts = F.struct(figure("Integrated loudness", "I", "LUFS").alias("lufs"), figure("Loudness range", "LRA", "LU").alias("lra"), figure("True peak", "Peak", "dBFS").alias("peak"))
    return F.when(lufs != "", parts)


def replay_gain(tag: Column) -> Column:
    """The first number of a gain tag."""
    return F.nullif(F.regexp_extract(tag, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def block_signature(content: Column, back: int = 262144, block: int = 65536) -> Column:
    """SHA-1 of one block that begins ``back`` bytes before the end, or of all of less."""
    size = F.octet_length(content)
    return F.sha1(F.when(size > back, F.substring(content, size - back + 1, F.lit(block))).otherwise(content))


def stars_from_byte(b: Column) -> Column:
    """A popularity byte as 0 to 5 stars."""
    return F.when(b.isNull() | (b <= 0), 0).when(b < 32, 1).when(b < 96, 2).when(b < 160, 3).when(b < 224, 4).otherwise(5)


def stars_from_number(v: Column) -> Column:
    """Stars of a rating on a scale to 1, 5 or 100."""
    n = v.cast("double")
    on_five = F.when(n <= 1, n * 5).when(n <= 5, n).otherwise(n / 20)
    return F.when(n.isNull() | (n <= 0), 0).otherwise(F.least(F.lit(5), F.greatest(F.lit(1), F.floor(on_five + 0.5)))).cast("int")


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def known_year(original: Column, tagged: Column) -> Column:
    return F.coalesce(F.nullif(original, F.lit(0)), F.nullif(tagged, F.lit(0)), F.lit(0))


def gap(a: Column, b: Column, scale: float, unknown: float = 0.5) -> Column:
    """Scaled difference; ``unknown`` where either side is null or 0."""
    missing = a.isNull() | b.isNull() | (a == 0) | (b == 0)
    return F.when(missing, F.lit(unknown)).otherwise(F.abs(a - b) / F.lit(scale))


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: How well each degree fits a major and a minor key.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def key_profiles() -> list[list[float]]:
    """The standardised profiles of all keys: C major, C minor, C sharp major and so on."""
    out = []
    for tonic in range(12):
        for profile in (MAJOR, MINOR):
            mean = sum(profile) / 12
            deviation = (sum((x - mean) ** 2 for x in profile) / 12) ** 0.5
            out.append([(profile[(k - tonic) % 12] - mean) / deviation for k in range(12)])
    return out


def key_of(chroma: Column) -> Column:
    """``tonic`` and ``major`` of the key whose profile correlates best with twelve chroma means, the first of equals; null where they are flat."""
    c = chroma.cast("array<double>")
    mean = F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / 12
    spread = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / 12)
    profiles = F.array(*[F.array(*map(F.lit, p)) for p in key_profiles()])
    fits = F.transform(profiles, lambda p: F.round(F.aggregate(F.zip_with(c, p, lambda x, y: (x - mean) * y), F.lit(0.0), lambda s, x: s + x) / spread, 9))
    place = (F.array_position(fits, F.array_max(fits)) - 1).cast("int")
    return F.when(c.isNotNull() & (spread >= 1e-9), F.struct(F.floor(place / 2).cast("int").alias("tonic"), (place % 2 == 0).alias("major")))


def key_compatibility(tonic_a: Column, major_a: Column, tonic_b: Column, major_b: Column) -> Column:
    """1 the same key, .8 a fifth away or relative, .4 two fifths, else 0; .5 where one is unknown."""
    step = F.pmod(tonic_b - tonic_a, F.lit(12))
    same_mode = F.when(step == 0, 1.0).when(step.isin(5, 7), 0.8).when(step.isin(2, 10), 0.4).otherwise(0.0)
    minor, major = F.when(major_a, tonic_b).otherwise(tonic_a), F.when(major_a, tonic_a).otherwise(tonic_b)
    relative = F.when(F.pmod(minor + 3, F.lit(12)) == major, 0.8).otherwise(0.0)
    unknown = tonic_a.isNull() | tonic_b.isNull()
    return F.when(unknown, 0.5).when(major_a == major_b, same_mode).otherwise(relative)
