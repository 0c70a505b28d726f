"""Queries on catalogs: selections, rules, matching, merges and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, evaluation, matching, merge, rules
from ..operators.rules import Field
from .registry import TRACKS, query, table, tracks

#: Fixed value: the instant that time rules compare with (2024-02-01 UTC).
NOW = 1706745600

EVENT_KEY = "(json_extract_string(props, '$.k'))::BIGINT"
MARKS = f"""marks AS (
  SELECT {EVENT_KEY} AS id, count(*) FILTER (WHERE event_type = 'view') AS plays, count(*) FILTER (WHERE event_type = 'error') AS skips,
         (count(*) FILTER (WHERE event_type = 'purchase') > 18)::INT AS loved, (count(*) FILTER (WHERE event_type = 'click') % 6) AS rating,
         coalesce(epoch(max(ts) FILTER (WHERE event_type = 'view'))::BIGINT, 0) AS last_played
  FROM events GROUP BY 1),
used AS (SELECT t.*, coalesce(plays, 0) AS plays, coalesce(skips, 0) AS skips, coalesce(loved, 0) AS loved, coalesce(rating, 0) AS rating, coalesce(last_played, 0) AS last_played
  FROM tracks t LEFT JOIN marks USING (id))"""


def keyed_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("id", F.get_json_object("props", "$.k").cast("long"))


def used(spark, sf_dir) -> DataFrame:
    """Tracks with counters and marks from events; unknown is 0."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    seconds = F.round(F.unix_micros(F.max(F.when(F.col("event_type") == "view", F.col("ts").cast("timestamp")))) / 1e6).cast("long")
    marks = keyed_events(spark, sf_dir).groupBy("id").agg(
        kind("view").alias("plays"), kind("error").alias("skips"), (kind("purchase") > 18).cast("int").alias("loved"),
        (kind("click") % 6).alias("rating"), F.coalesce(seconds, F.lit(0)).alias("last_played"),
    )
    return tracks(spark, sf_dir).join(marks, "id", "left").fillna(0, ["plays", "skips", "loved", "rating", "last_played"])


@query(f"WITH {TRACKS} SELECT count(*) AS tracks, sum(seconds)::BIGINT AS seconds, count(DISTINCT lower(artist)) AS artists, count(DISTINCT lower(album)) AS albums, count(*) FILTER (WHERE seconds > 0) AS timed FROM tracks")
def library_stats(spark, sf_dir):
    return catalog.library_stats(tracks(spark, sf_dir))


@query(f"""WITH {TRACKS} SELECT * FROM (
  SELECT 'genre' AS pane, name, count(*) AS n FROM (SELECT unnest(genres) AS name FROM tracks WHERE artist IN ('Brand#1', 'Brand#2')) GROUP BY name
  UNION ALL SELECT 'artist', artist, count(*) FROM tracks WHERE list_contains(genres, 'red') GROUP BY artist
  UNION ALL SELECT 'album', album, count(*) FROM tracks WHERE list_contains(genres, 'red') AND artist IN ('Brand#1', 'Brand#2') GROUP BY album)""")
def facets_cascade(spark, sf_dir):
    return catalog.facets(tracks(spark, sf_dir), genres=["Red"], artists=["brand#1", "BRAND#2"])


@query(f"WITH {TRACKS}, s AS (SELECT * FROM tracks WHERE lower(artist || ' ' || album || ' ' || title) LIKE '%red%') SELECT id, title, (SELECT count(*) FROM s) AS total, (SELECT sum(seconds)::BIGINT FROM s) AS total_seconds FROM s ORDER BY lower(title), pool_i LIMIT 50 OFFSET 25")
def faceted_page(spark, sf_dir):
    found = catalog.select(tracks(spark, sf_dir), q="RED")
    return catalog.page(found, catalog.named_sort("title"), 25, 50).select("id", "title", "total", "total_seconds")


@query(f"WITH {TRACKS} SELECT lower(album) AS album, count(*) AS n, sum(seconds)::BIGINT AS seconds, min(pool_i) AS first_id, arg_min(title, pool_i) AS title FROM tracks GROUP BY lower(album)")
def album_grid(spark, sf_dir):
    return catalog.albums(tracks(spark, sf_dir), [F.lower("album").alias("album")])


@query("""WITH p AS (SELECT replace(replace(url, 'https://', ''), 'http://', '') AS path FROM pages), r AS (SELECT substr(path, 3) AS rest FROM p WHERE starts_with(path, 'm.'))
SELECT string_split(rest, '/')[1] AS name, contains(rest, '/') AS folder, count(*) AS n FROM r GROUP BY 1, 2""")
def folder_level(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    return catalog.folder_level(paths, "path", "m.")


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'Analyzed' WHEN toxic = 1 THEN 'Unanalyzable' ELSE 'Pending' END AS state FROM documents LEFT JOIN labels USING (doc_id)""")
def status_states(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    error = F.when(F.col("toxic") == 1, F.lit("decode failed"))
    return rows.select("doc_id", catalog.status(error, F.coalesce(F.col("quality") == 1, F.lit(False)), F.lit(64), 64).alias("state"))


@query("SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'no fingerprint' ELSE 'not reached' END AS why FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)")
def failures(spark, sf_dir):
    missing = table(spark, sf_dir, "part").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p_partkey")), "p_partkey", "left_anti")
    return missing.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, "no fingerprint").otherwise("not reached").alias("why"))


FIELDS = {
    "title": Field("text", "title"), "artist": Field("text", "artist"), "genre": Field("tags", "genres"), "year": Field("num", "year"), "bpm": Field("num", "bpm"),
    "plays": Field("num", "plays"), "rating": Field("num", "rating"), "loved": Field("bool", "loved"), "played": Field("date", "last_played"),
}


def ruled(name: str, spec: dict, sql: str, tail: str = ""):
    """Registers a saved list's rules and their SQL condition."""

    def run(spark, sf_dir):
        return rules.evaluate(used(spark, sf_dir), spec, FIELDS, NOW).select("id", "title")

    run.__name__ = name
    query(f"WITH {TRACKS}, {MARKS} SELECT id, title FROM used WHERE {sql} {tail}")(run)


def rule(field: str, op: str, value) -> dict:
    return {"field": field, "op": op, "value": value}


ruled("rules_numbers", {"match": "all", "conditions": [rule("year", "between", [1980, 2000]), rule("bpm", "gte", 90), rule("plays", "ne", 3)]}, "year BETWEEN 1980 AND 2000 AND bpm >= 90 AND plays <> 3")
ruled("rules_malformed_numbers", {"conditions": [rule("year", "between", "x"), rule("bpm", "gt", "y")]}, "year BETWEEN 0 AND 0 AND bpm > 0")
ruled("rules_text", {"match": "all", "conditions": [rule("title", "starts", "Red"), rule("artist", "not_contains", "#2")]}, "title LIKE 'red%' AND artist NOT LIKE '%#2%'")
ruled("rules_tags", {"match": "any", "conditions": [rule("genre", "is", "ECONOMY"), rule("genre", "contains", "wid")]}, "list_contains(genres, 'economy') OR len(list_filter(genres, lambda t: t LIKE '%wid%')) > 0")
ruled("rules_dates", {"conditions": [rule("played", "not_in_last_days", 2), rule("rating", "gte", 2)]}, f"(last_played <= 0 OR last_played < {NOW - 2 * 86400}) AND rating >= 2")
ruled("rules_loved", {"conditions": [rule("loved", "is", "yes")]}, "loved = 1")
ruled("rules_none", {"conditions": []}, "true")
ruled("rules_sorted", {"conditions": [rule("year", "gt", 1990)], "sort": "bpm", "desc": True, "limit": 100}, "year > 1990", "ORDER BY bpm DESC, pool_i LIMIT 100")


@query(f"WITH {TRACKS}, {MARKS} SELECT * FROM (SELECT 'loved' AS view, count(*) AS n FROM used WHERE loved = 1 UNION ALL SELECT 'toprated', count(*) FROM used WHERE rating >= 4 UNION ALL SELECT 'unrated', count(*) FROM used WHERE rating = 0 UNION ALL SELECT 'mostplayed', count(*) FROM used WHERE plays > 0 UNION ALL SELECT 'neverplayed', count(*) FROM used WHERE plays = 0 UNION ALL SELECT 'recent', count(*) FROM used WHERE last_played >= {NOW - 30 * 86400})")
def smart_views(spark, sf_dir):
    rows, out = used(spark, sf_dir), None
    for name in ("loved", "toprated", "unrated", "mostplayed", "neverplayed", "recent"):
        n = catalog.smart_view(rows, name, NOW).agg(F.lit(name).alias("view"), F.count(F.lit(1)).alias("n")).select("view", "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"WITH {TRACKS}, {MARKS}, t AS (SELECT id, CASE WHEN loved = 1 AND last_played < {NOW - 14 * 86400} THEN 1 WHEN rating >= 4 THEN 2 ELSE 3 END AS tier FROM used) SELECT id, tier FROM t WHERE tier = (SELECT min(tier) FROM t)")
def genius_tier(spark, sf_dir):
    return catalog.seed_tier(used(spark, sf_dir), NOW).select("id", "tier")


@query(f"WITH {TRACKS} SELECT id, title FROM tracks WHERE contains(lower(artist || ' - ' || title), 'd r') ORDER BY pool_i LIMIT 40")
def search_label(spark, sf_dir):
    return tracks(spark, sf_dir).where(F.lower(F.concat_ws(" - ", "artist", "title")).contains("d r")).orderBy("pool_i").limit(40).select("id", "title")


@query(f"WITH {TRACKS} SELECT id, title FROM tracks WHERE contains(lower(artist || ' ' || title || ' ' || album), 'red') AND contains(lower(artist || ' ' || title || ' ' || album), '#1')")
def search_all_terms(spark, sf_dir):
    """Every term of the query occurs in artist, title or album."""
    hay = F.lower(F.concat_ws(" ", "artist", "title", "album"))
    return tracks(spark, sf_dir).where(F.forall(F.split(F.lit("red #1"), r"\s+"), lambda t: F.contains(hay, t))).select("id", "title")


@query(f"WITH {TRACKS} SELECT min(pool_i) AS id, lower(trim(artist)) || '|' || lower(trim(title)) AS key FROM tracks GROUP BY 2")
def dedup_first_wins(spark, sf_dir):
    rows = tracks(spark, sf_dir).withColumn("key", text.duplicate_key("song", F.col("artist"), F.col("title"), F.lit("")))
    return rows.groupBy("key").agg(F.min("pool_i").alias("id"))


@query(f"WITH {TRACKS} SELECT id FROM tracks WHERE lower(trim(artist)) NOT IN ('brand#1', 'brand#3') AND id NOT IN (5, 6, 7)")
def bans(spark, sf_dir):
    return tracks(spark, sf_dir).where(~F.lower(F.trim("artist")).isin("brand#1", "brand#3") & ~F.col("id").isin(5, 6, 7)).select("id")


@query(f"WITH {TRACKS}, c AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01') SELECT t.id FROM tracks t SEMI JOIN c USING (id)")
def collection_mask(spark, sf_dir):
    chosen = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("id"))
    return tracks(spark, sf_dir).join(chosen, "id", "left_semi").select("id")


@query(f"WITH {TRACKS}, r AS (SELECT id, artist, row_number() OVER (PARTITION BY artist ORDER BY pool_i) AS n FROM tracks) SELECT id, artist FROM r WHERE n <= 8")
def artist_votes(spark, sf_dir):
    """At most eight rows an artist, in pool order."""
    return catalog.per_key(tracks(spark, sf_dir), F.col("artist"), 8, [F.col("pool_i")]).select("id", "artist")


PLAIN = r"trim(regexp_replace({0}, '[^a-z0-9]+', ' ', 'g'))"
TITLE = r"regexp_replace(regexp_replace(lower(text), '[\(\[].*?[\)\]]', '', 'g'), '\s*-\s*(live|remaster(ed)?|mono|stereo|single version|album version|previously unreleased|alternate take|alt\.? take|demo|edit|radio edit|acoustic|instrumental|take \d+)\b.*$', '', 'g')"


@query(f"""SELECT doc_id, CASE WHEN {PLAIN.format(TITLE)} <> '' THEN {PLAIN.format('lower(source)')} || '|' || {PLAIN.format(TITLE)} END AS key FROM documents""")
def twin_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.twin_key(F.col("source"), F.col("text")).alias("key"))


NORMAL = r"trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(lower({0})), '&', ' and '), '\b(feat|ft|featuring|with)\b.*$', ' ', 'g'), '\(.*?\)|\[.*?\]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), '^(the|a|an)\s+', ''))"


@query(f"SELECT item_id, {NORMAL.format('text')} AS key FROM benchmark")
def normalised_keys(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.match_key(F.col("text")).alias("key"))


@query(r"SELECT page_id, array_to_string(list_slice(p, greatest(len(p) - 2, 1), len(p)), '/') AS key FROM (SELECT page_id, list_filter(string_split(lower(replace(url, '\', '/')), '/'), lambda x: x <> '') AS p FROM pages)")
def tail_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.tail_key(F.col("url")).alias("key"))


def _catalogs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = tracks(spark, sf_dir).select("id", F.concat_ws("/", "artist", "title").alias("path"), "artist", "title", "album", "seconds")
    other = t.withColumns({"path": F.concat_ws("/", "album", F.lower("title")), "seconds": F.col("seconds") + F.col("id") % 9})
    return t, other


RESOLVED = f"""{TRACKS}, t AS (SELECT id, artist || '/' || title AS path, artist, title, album, seconds, {NORMAL.format('artist')} AS a, {NORMAL.format('title')} AS tt, {NORMAL.format('album')} AS al FROM tracks),
s AS (SELECT * FROM t), c AS (SELECT * REPLACE (seconds + id % 9 AS seconds, album || '/' || lower(title) AS path) FROM t),
j AS (SELECT s.id AS sid, s.seconds AS ss, s.al AS sal, c.*, k.tier FROM s JOIN c ON true CROSS JOIN (SELECT unnest([0, 1, 2]) AS tier) k
  WHERE (tier = 0 AND lower(s.title) = lower(c.title)) OR (tier = 1 AND s.tt = c.tt AND s.tt <> '' AND s.a = c.a AND s.a <> '')
     OR (tier = 2 AND s.tt = c.tt AND s.tt <> '' AND s.a <> '' AND (contains(c.a, s.a) OR contains(s.a, c.a)))),
d AS (SELECT *, CASE WHEN ss > 0 AND seconds > 0 THEN abs(seconds - ss)::DOUBLE ELSE 999.0 END AS drift, CASE WHEN sal <> '' AND sal = al THEN -2.0 ELSE 0 END
  + CASE WHEN a = 'various artists' THEN 1.5 ELSE 0 END + CASE WHEN regexp_matches(tt, '\\b(live|remix|karaoke|instrumental|acoustic|demo|edit)\\b') THEN 1 ELSE 0 END AS penalty FROM j),
b AS (SELECT *, CASE WHEN drift <= 2 THEN 0 WHEN drift <= 8 THEN 1 ELSE 2 END AS bucket FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY sid, tier ORDER BY bucket, penalty, drift, path, id) AS place FROM b),
h AS (SELECT * FROM p WHERE place = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY CASE WHEN bucket = 0 THEN tier ELSE 9 END, drift, tier) AS choice FROM h),
resolved AS (SELECT s.id, g.id AS match_id, ['basename', 'artist+title', 'title-only'][g.tier + 1] AS tier,
  CASE WHEN g.bucket = 0 THEN ['exact', 'strong', 'probable'][g.tier + 1] WHEN g.bucket = 1 THEN 'probable' WHEN g.bucket = 2 THEN 'weak' END AS grade, round(g.drift, 2) AS drift,
  CASE WHEN g.id IS NOT NULL THEN (SELECT count(*) FROM p WHERE p.sid = s.id AND p.tier = g.tier AND p.place > 1 AND p.bucket = g.bucket AND p.penalty = g.penalty AND abs(p.drift - g.drift) < 0.5) END AS ties
FROM s LEFT JOIN (SELECT * FROM g WHERE choice = 1) g ON g.sid = s.id)"""


@query(f"WITH {RESOLVED} SELECT * FROM resolved")
def entity_resolve(spark, sf_dir):
    return matching.resolve(*_catalogs(spark, sf_dir))


REPORTED = RESOLVED + """,
m AS (SELECT r.*, s.path, min(row(s.path, s.id)) OVER (PARTITION BY match_id) AS claim FROM resolved r JOIN s USING (id)),
o AS (SELECT id, path, match_id, tier, grade, drift, ties, CASE WHEN match_id IS NULL THEN 'residue' WHEN claim[2] = id THEN 'resolved' ELSE 'duplicate' END AS outcome, claim[1] AS claimed FROM m),
reported AS (SELECT *, outcome = 'resolved' AND (grade IN ('probable', 'weak') OR ties > 0) AS flagged FROM o)"""


@query(f"WITH {REPORTED} SELECT id, path, match_id, tier, grade, drift, ties, outcome, coalesce(flagged, false) AS flagged, CASE WHEN outcome = 'duplicate' THEN claimed END AS same_as FROM reported")
def resolve_report(spark, sf_dir):
    """What becomes of each row: resolved, residue or a duplicate, and which to look at."""
    source, catalog = _catalogs(spark, sf_dir)
    return matching.report(source, matching.resolve(source, catalog)).withColumn("flagged", F.coalesce("flagged", F.lit(False)))


@query(f"""WITH {REPORTED} SELECT count(*) AS source, count(*) FILTER (outcome = 'resolved') AS resolved, count(*) FILTER (outcome = 'residue') AS residue, count(*) FILTER (flagged) AS flagged,
count(*) FILTER (outcome = 'duplicate') AS dupes, {', '.join(f"count(*) FILTER (outcome = 'resolved' AND grade = '{g}') AS {g}" for g in ('exact', 'strong', 'probable', 'weak'))} FROM reported""")
def resolve_counts(spark, sf_dir):
    source, catalog = _catalogs(spark, sf_dir)
    return matching.report_counts(matching.report(source, matching.resolve(source, catalog)))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.p AS a, b.p AS b, sum(CASE WHEN abs(b.n - a.n) <= 3 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight FROM l a JOIN l b ON a.k = b.k AND a.p < b.p GROUP BY 1, 2""")
def cooccurrence_pairs(spark, sf_dir):
    """Pairs of one list, heavier where near in it; lists are short."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p")).agg(F.min("l_linenumber").alias("n"))
    a, b = rows.select("k", F.col("p").alias("a"), F.col("n").alias("na")), rows.select("k", F.col("p").alias("b"), F.col("n").alias("nb"))
    near = F.when(F.abs(F.col("nb") - F.col("na")) <= 3, 2.0).otherwise(1.0)
    return a.join(b, "k").where("a < b").groupBy("a", "b").agg(F.sum(near).alias("weight"))


@query("""WITH l AS (SELECT l_orderkey AS k, sha1(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey)) AS digest, count(*) AS n FROM lineitem GROUP BY 1)
SELECT digest, min(k) AS list_id, count(*) AS copies FROM l WHERE n >= 3 GROUP BY digest""")
def list_fingerprint_dedupe(spark, sf_dir):
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("x")).where(F.size("x") >= 3)
    digest = F.sha1(F.array_join(F.transform("x", lambda m: m["l_partkey"].cast("string")), ",").cast("binary"))
    return lists.select(digest.alias("digest"), "l_orderkey").groupBy("digest").agg(F.min("l_orderkey").alias("list_id"), F.count(F.lit(1)).alias("copies"))


@query("""WITH l AS (SELECT l_orderkey AS k, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
SELECT count(DISTINCT l_partkey) AS covered, (SELECT count(*) FROM part) AS parts, count(DISTINCT l_partkey) >= 500 AND (SELECT count(*) FROM l WHERE n > 1) >= 20 AS go FROM lineitem JOIN l ON l.k = l_orderkey AND l.n > 1""")
def coverage_gate(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    lists = items.distinct().groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    covered = items.join(lists, "l_orderkey", "left_semi").agg(F.countDistinct("l_partkey").alias("covered"))
    sizes = lists.agg(F.count(F.lit(1)).alias("lists")).crossJoin(table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("parts")))
    return covered.crossJoin(sizes).select("covered", "parts", ((F.col("covered") >= 500) & (F.col("lists") >= 20)).alias("go"))


@query("""WITH l AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2), o AS (SELECT * FROM l WHERE l_orderkey % 2 = 0), w AS (SELECT l_orderkey - 1 AS k, l_partkey, n FROM l WHERE l_orderkey % 2 = 1)
SELECT coalesce(o.l_orderkey, w.k) AS list, coalesce(o.l_partkey, w.l_partkey) AS item, CASE WHEN w.n IS NULL THEN 'gone' WHEN o.n IS NULL THEN 'added' WHEN o.n = w.n THEN 'kept' ELSE 'moved' END AS change
FROM o FULL JOIN w ON o.l_orderkey = w.k AND o.l_partkey = w.l_partkey""")
def playlist_diff(spark, sf_dir):
    """Each even list against the odd one after it."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_partkey").alias("item")).agg(F.min("l_linenumber").alias("n"))
    old = rows.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("list"), "item", F.col("n").alias("was"))
    new = rows.where("l_orderkey % 2 = 1").select((F.col("l_orderkey") - 1).alias("list"), "item", F.col("n").alias("now"))
    change = F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "added").when(F.col("was") == F.col("now"), "kept").otherwise("moved")
    return old.join(new, ["list", "item"], "full_outer").select("list", "item", change.alias("change"))


@query("""WITH t AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k, sum(n) OVER (PARTITION BY p_brand) AS size FROM t)
SELECT p_brand AS cluster, p_type AS tag, n, round(n / size, 6)::DOUBLE AS share FROM r WHERE k <= 3""")
def cluster_report(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("cluster"), F.col("p_type").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "tag"))
    size = F.sum("n").over(Window.partitionBy("cluster"))
    return counts.select("cluster", "tag", "n", F.round(F.col("n") / size, 6).alias("share"), place.alias("k")).where("k <= 3").drop("k")


UPDATES = "new AS (SELECT p_partkey, p_name || ' v2' AS p_name, p_size + 1 AS p_size FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey + 100000, p_name, p_size FROM part WHERE p_partkey < 50), base AS (SELECT p_partkey, p_name, p_size FROM part)"


def _updates(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    changed = base.where("p_partkey % 3 = 0").select("p_partkey", F.concat("p_name", F.lit(" v2")).alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    return base, changed.unionByName(base.where("p_partkey < 50").withColumn("p_partkey", F.col("p_partkey") + 100000))


@query(f"WITH {UPDATES} SELECT * FROM new UNION ALL SELECT * FROM base WHERE p_partkey NOT IN (SELECT p_partkey FROM new)")
def upsert(spark, sf_dir):
    return merge.upsert(*_updates(spark, sf_dir), "p_partkey")


@query(f"WITH {UPDATES}, n AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name END AS p_name, CASE WHEN p_size % 5 > 0 THEN p_size END AS p_size FROM new), g AS (SELECT * FROM n WHERE p_name IS NOT NULL OR p_size IS NOT NULL) SELECT coalesce(b.p_partkey, g.p_partkey) AS p_partkey, coalesce(g.p_name, b.p_name) AS p_name, coalesce(g.p_size, b.p_size) AS p_size FROM base b FULL JOIN g ON b.p_partkey = g.p_partkey")
def coalescing_upsert(spark, sf_dir):
    base, new = _updates(spark, sf_dir)
    partial = new.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("p_name"), F.when(F.col("p_size") % 5 > 0, F.col("p_size")).alias("p_size"))
    return merge.coalescing_upsert(base, partial, "p_partkey")


@query("""WITH m AS (SELECT p_partkey AS old, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 1 ELSE p_partkey + 500000 END AS new FROM part WHERE p_partkey % 10 IN (0, 3)),
r AS (SELECT coalesce(m.new, p_partkey) AS p_partkey, p_name, m.old FROM part LEFT JOIN m ON m.old = p_partkey),
f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY old IS NOT NULL, old) AS n FROM r) SELECT p_partkey, p_name FROM f WHERE n = 1""")
def rekey(spark, sf_dir):
    """Moved keys; where the new key is taken, the row that had it stays."""
    base = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    key = F.col("p_partkey")
    moves = base.where((key % 10).isin(0, 3)).select(key.alias("old"), F.when(key % 2 == 0, key + 1).otherwise(key + 500000).alias("new"))
    return merge.rekey(base, moves, "p_partkey")


@query("WITH gone AS (SELECT p_partkey FROM part WHERE p_size < 10) SELECT 'lineitem' AS name, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT * FROM gone) UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT * FROM gone)")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"))
    tables = {"lineitem": table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")), "embeddings": table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))}
    out = None
    for name, left in merge.cascade_delete(tables, gone, "id").items():
        n = left.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"SELECT {EVENT_KEY} AS id, count(*) FILTER (WHERE event_type = 'view') AS plays, count(*) FILTER (WHERE event_type = 'error') AS skips, max(ts) FILTER (WHERE event_type = 'view') AS last_played FROM events GROUP BY 1")
def counter_upsert(spark, sf_dir):
    return merge.counted(keyed_events(spark, sf_dir), "id")


@query("SELECT DISTINCT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings WHERE label < 8) OR p_size = 1")
def todo_select(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    done = table(spark, sf_dir, "embeddings").where("label < 8").select(F.col("vec_id").alias("id"))
    return merge.to_do(part.select(F.col("p_partkey").alias("id")), done, part.where("p_size = 1").select(F.col("p_partkey").alias("id")), "id")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, min(ts) AS start, count(*) AS n FROM s GROUP BY 1, 2""")
def sessions(spark, sf_dir):
    """Runs of a user's events no more than 30 minutes apart."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    apart = F.col("ts") - F.lag("ts").over(order) <= F.expr("INTERVAL 30 MINUTES")
    marked = table(spark, sf_dir, "events").withColumn("new", F.when(apart, 0).otherwise(1))
    numbered = marked.withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_by_day(spark, sf_dir):
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy(day.alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, octet_length(encode(text))::INT AS bytes FROM conversations")
def turn_transitions(spark, sf_dir):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", before.alias("before"), F.octet_length("text").alias("bytes"))


@query("SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY CUBE (p_brand, p_type)")
def sweep_cells(spark, sf_dir):
    """Means over a grid with its margins."""
    return table(spark, sf_dir, "part").cube("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@query("""WITH p AS (SELECT p_partkey AS id, p_brand AS g, hash_value FROM (SELECT *, md5(p_partkey::VARCHAR) AS hash_value FROM part)),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY hash_value) - 1 AS k FROM p) SELECT id, (k % 5)::INT AS fold FROM n""")
def holdout_folds(spark, sf_dir):
    """Five folds, even within each group."""
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.md5(F.col("p_partkey").cast("string")))) - 1
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (place % 5).alias("fold"))


@query("""WITH n AS (SELECT p_brand AS judge, chr((65 + p_size % 6)::INT) AS letter, count(*) AS n FROM part GROUP BY 1, 2),
g AS (SELECT judge, n, string_agg(letter, '=' ORDER BY letter) AS grp FROM n GROUP BY 1, 2),
r AS (SELECT judge, string_agg(grp, '>' ORDER BY n DESC) AS ranking FROM g GROUP BY 1),
s AS (SELECT judge, unnest(string_split(ranking, '>')) AS grp, generate_subscripts(string_split(ranking, '>'), 1) AS place FROM r)
SELECT judge, place::INT AS place, unnest(string_split(grp, '=')) AS letter FROM s""")
def ranking_groups(spark, sf_dir):
    """Blind rankings of six letters, one a brand, written as text ("B>A=C") and taken apart again."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("judge"), F.chr(65 + F.col("p_size") % 6).alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    tied = counts.groupBy("judge", "n").agg(F.array_join(F.array_sort(F.collect_list("letter")), "=").alias("grp"))
    written = tied.groupBy("judge").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "grp")), asc=False), lambda g: g["grp"]), ">").alias("ranking"))
    return evaluation.ranked_letters(written, "judge", "ranking")


@query("SELECT vec_id AS seed FROM embeddings WHERE vec_id % 20 = 0 AND vec_id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def seeds_outside(spark, sf_dir):
    """The seeds that a collection does not hold."""
    seeds = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("seed"))
    return evaluation.outside(seeds, "seed", table(spark, sf_dir, "part").where("p_size <= 25"), "p_partkey")
