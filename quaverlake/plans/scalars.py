"""Queries on small conversions: tags, paths, ratings, keys and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog
from .catalog import MARKS, used
from .registry import TRACKS, query, table

GENRE = "replace(p_name, ' ', '; ') || ',' || upper(p_type) || '/Covers; Red'"


@query(f"""WITH g AS (SELECT p_partkey AS id, {GENRE} AS g FROM part),
t AS (SELECT id, g, list_filter(list_transform(string_split_regex(g, '[;,]'), lambda x: lower(trim(x))), lambda x: x <> '') AS tags,
  list_filter(list_transform(string_split(g, ';'), lambda x: trim(x)), lambda x: x <> '') AS listed, list_filter(list_transform(string_split_regex(g, '[/,]'), lambda x: lower(trim(x))), lambda x: x <> '') AS slashed FROM g)
SELECT id, array_to_string(list_sort(list_distinct(tags)), '|') AS tags, array_to_string(listed, '|') AS listed, array_to_string(list_sort(list_distinct(slashed)), '|') AS slashed,
  trim(string_split(string_split(g, ',')[1], ';')[1]) AS primary_genre, array_to_string(list_sort(list_filter(list_distinct(list_concat(tags, ['cover', 'jazz'])), lambda x: x NOT IN ('covers', 'cover'))), '|') AS styled FROM t""")
def tag_scalars(spark, sf_dir):
    genre = F.concat(F.replace("p_name", F.lit(" "), F.lit("; ")), F.lit(","), F.upper("p_type"), F.lit("/Covers; Red"))
    joined = lambda c: F.array_join(F.array_sort(c), "|")
    tags, style = text.tags(genre), F.array(F.lit("cover"), F.lit("jazz"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), joined(tags).alias("tags"), F.array_join(text.listed_genres(genre), "|").alias("listed"), joined(text.slash_tags(genre)).alias("slashed"),
        text.primary_genre(genre).alias("primary_genre"), joined(text.with_style(tags, style)).alias("styled"),
    )


@query(r"""WITH p AS (SELECT page_id AS id, replace(url, '\', '/') AS u FROM pages)
SELECT id, string_split(u, '/')[-1] AS base, regexp_replace(u, '/[^/]*$', '') AS folder, upper(regexp_extract(string_split(u, '/')[-1], '\.([^.]*)$', 1)) AS extension,
  regexp_replace(regexp_replace(lower(u), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, trim(regexp_replace(u, '[<>:"/\\|?*]', '_', 'g'), '. ')[:120] AS safe FROM p""")
def path_scalars(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), text.basename(u).alias("base"), text.dirname(u).alias("folder"), text.extension(u).alias("extension"), text.slug(u).alias("slug"), text.safe_component(F.replace(u, F.lit("\\"), F.lit("/"))).alias("safe"),
    )


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS n, p_partkey % 256 AS b, (p_partkey % 120)::DOUBLE AS v, p_size || ' ' || p_name AS name FROM part)
SELECT id, (n * 7 // 60) || ':' || lpad((n * 7 % 60)::VARCHAR, 2, '0') AS clock, n AS track, CASE WHEN b = 0 THEN 0 WHEN b < 32 THEN 1 WHEN b < 96 THEN 2 WHEN b < 160 THEN 3 WHEN b < 224 THEN 4 ELSE 5 END AS stars,
  CASE WHEN v <= 0 THEN 0 ELSE least(5, greatest(1, floor(CASE WHEN v <= 1 THEN v * 5 WHEN v <= 5 THEN v ELSE v / 20 END + 0.5)))::INT END AS rated,
  CASE WHEN n % 3 > 0 THEN n % 3 WHEN n % 5 > 0 THEN n % 5 ELSE 0 END AS year, (n // 10 * 10)::INT AS decade FROM p""")
def number_scalars(spark, sf_dir):
    n, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), text.clock(n * 7).alias("clock"), text.track_number(F.concat_ws(" ", n.cast("string"), "p_name")).alias("track"), text.stars_from_byte(key % 256).alias("stars"),
        text.stars_from_number(key % 120).alias("rated"), text.known_year(n % 3, n % 5).alias("year"), text.decade(n).alias("decade"),
    )


@query("SELECT doc_id, lower(strip_accents(replace(replace(replace(replace(text, '‘', ''''), '’', ''''), '“', '\"'), '”', '\"'))) AS folded FROM documents WHERE text IS NOT NULL")
def folded_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.folded(F.col("text")).alias("folded"))


REPORT = "'Summary:\n  Integrated loudness:\n    I: -1.0 LUFS\nframe\nSummary:\n\n  Integrated loudness:\n    I:         -' || p_size || '.5 LUFS\n  Loudness range:\n    LRA:         ' || (p_size % 9) || '.2 LU\n  True peak:\n    Peak:       ' || CASE WHEN p_size % 4 = 0 THEN '-inf' ELSE '-0.3' END || ' dBFS'"


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 > 0 THEN -(p_size + 0.5)::DOUBLE END AS lufs, CASE WHEN p_partkey % 5 > 0 THEN (p_size % 9 + 0.2)::DOUBLE END AS lra, CASE WHEN p_partkey % 5 > 0 AND p_size % 4 > 0 THEN -0.3::DOUBLE END AS peak,
  CASE WHEN p_size % 2 = 0 THEN -(p_size + 0.25)::DOUBLE END AS gain FROM part""")
def loudness_reports(spark, sf_dir):
    """Figures read back from made-up loudness reports and gain tags."""
    n = F.col("p_size")
    report = F.when(F.col("p_partkey") % 5 > 0, F.expr(REPORT.replace("\n", "\\n"))).otherwise("no such file")
    found = text.loudness_summary(report)
    gain = text.replay_gain(F.when(n % 2 == 0, F.concat(F.lit("-"), (n + 0.25).cast("string"), F.lit(" dB"))).otherwise("none"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), found["lufs"].alias("lufs"), found["lra"].alias("lra"), found["peak"].alias("peak"), gain.alias("gain"))


@query("SELECT page_id AS id, CASE WHEN octet_length(b) > 3000 THEN sha1(array_slice(b, octet_length(b) - 2999, octet_length(b) - 1976)) ELSE sha1(b) END AS signature FROM (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages)")
def block_signatures(spark, sf_dir):
    content = F.coalesce("html", F.lit("")).cast("binary")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), text.block_signature(content, 3000, 1024).alias("signature"))


@query(f"""WITH c AS (SELECT vec_id AS id, list_transform(embedding[1:12], lambda x: x::DOUBLE) AS c FROM embeddings), p AS (SELECT {[[round(x, 12) for x in p] for p in text.key_profiles()]}::DOUBLE[][] AS p),
f AS (SELECT id, list_transform(p, lambda q: list_inner_product(list_transform(c, lambda x: x - list_avg(c)), q)) AS f FROM c, p)
SELECT id, ((list_position(f, list_max(f)) - 1) // 2)::INT AS tonic, (list_position(f, list_max(f)) - 1) % 2 = 0 AS major FROM f""")
def key_estimates(spark, sf_dir):
    """The key of the first twelve components, as if they were chroma."""
    key = text.key_of(F.slice("embedding", 1, 12))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), key["tonic"].alias("tonic"), key["major"].alias("major"))


SORTS = {
    "track": "track_no, lower(title)", "title": "lower(title)", "artist": "lower(artist), lower(album), track_no", "album": "lower(album), track_no", "genre": "CASE WHEN genre = '' THEN chr(65535) ELSE genre END, lower(artist)",
    "length": "seconds", "year": "year", "rating": "rating DESC, lower(artist), lower(album), track_no", "plays": "plays DESC, last_played DESC", "added": "date_added DESC", "status": "state_order, lower(artist)",
    "bpm": "nullif(bpm, 0) DESC NULLS LAST, lower(artist)", "bitrate": "nullif(bitrate, 0) DESC NULLS LAST, lower(artist)", "size": "bytes DESC", "filedate": "mtime DESC", "format": "upper(regexp_extract(path, '\\.([^.]*)$', 1)), lower(artist)", "path": "lower(path)",
}
SORTED = f"""WITH {TRACKS}, {MARKS}, s AS (SELECT *, id % 30 AS track_no, CASE WHEN id % 4 > 0 THEN lower(string_split(title, ' ')[1]) ELSE '' END AS genre, id * 7 % 1000 AS date_added, id % 3 AS state_order, id % 6 * 64 AS bitrate, id * 13 % 997 AS bytes,
  id * 17 % 991 AS mtime, album || '/' || title || CASE WHEN id % 2 = 0 THEN '.mp3' ELSE '.flac' END AS path FROM used) """


@query(SORTED + " UNION ALL ".join(f"SELECT '{k}' AS sort, id, n::INT AS place FROM (SELECT id, row_number() OVER (ORDER BY {v}, pool_i) AS n FROM s) WHERE n <= 25" for k, v in SORTS.items()))
def named_sorts(spark, sf_dir):
    """The first rows by each named sort of a library view."""
    key = F.col("id")
    rows = used(spark, sf_dir).withColumns({
        "track_no": key % 30, "genre": F.when(key % 4 > 0, F.lower(F.element_at("genres", 1))).otherwise(""), "date_added": key * 7 % 1000, "state_order": key % 3, "bitrate": key % 6 * 64, "bytes": key * 13 % 997,
        "mtime": key * 17 % 991, "path": F.concat("album", F.lit("/"), "title", F.when(key % 2 == 0, ".mp3").otherwise(".flac")),
    })
    out = None
    for name in SORTS:
        # a limit first, so that the numbers are given to a few rows
        first = rows.orderBy(*catalog.named_sort(name)).limit(25).agg(F.collect_list("id").alias("ids"))
        placed = first.select(F.lit(name).alias("sort"), F.posexplode("ids").alias("k", "id")).select("sort", "id", (F.col("k") + 1).alias("place"))
        out = placed if out is None else out.unionByName(placed)
    return out
