"""Queries on lists on their way out: orders as playlists of their parts."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import exports
from .registry import TRACKS, query, table, tracks

#: So many lines are grouped in one task.
ROWS = 500_000
ROOT, UNC, PLEX = "M:\\Music Library\\", "\\\\NAS\\music\\", "/data/music/"
PATHS = """paths AS (SELECT page_id AS id, replace(regexp_replace(url, '^https?://', ''), '?', '') AS tail, page_id % 5 AS k FROM pages),
local AS (SELECT id, k, tail, CASE k WHEN 0 THEN 'M:\\Music Library Backup\\' WHEN 1 THEN 'D:\\Old\\music library\\' WHEN 2 THEN 'E:\\other\\' ELSE 'm:\\Music Library\\' END || replace(tail, '/', '\\') AS path FROM paths)"""


def _paths(spark, sf_dir) -> DataFrame:
    tail, k = F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("?"), F.lit("")), F.col("page_id") % 5
    root = F.when(k == 0, "M:\\Music Library Backup\\").when(k == 1, "D:\\Old\\music library\\").when(k == 2, "E:\\other\\").otherwise("m:\\Music Library\\")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(root, F.replace(tail, F.lit("/"), F.lit("\\"))).alias("path"))


@query(f"WITH {PATHS} SELECT id, CASE WHEN k IN (1, 3, 4) THEN '\\\\NAS\\music\\' || replace(tail, '/', '\\') END AS unc, CASE WHEN k IN (1, 3, 4) THEN '/data/music/' || tail END AS plex FROM local")
def path_flavours(spark, sf_dir):
    """Paths below the root, or below a folder named like it; others are not rewritten."""
    return _paths(spark, sf_dir).select("id", *[exports.flavoured(F.col("path"), ROOT, k, t).alias(k) for k, t in (("unc", UNC), ("plex", PLEX))])


@query("SELECT 'unc' AS requested, 'mixed' AS used, true AS fallback, count(*) FILTER (WHERE page_id % 5 IN (0, 2)) AS fallback_count, count(*) AS total FROM pages")
def flavour_report(spark, sf_dir):
    return exports.flavour_report(_paths(spark, sf_dir), "path", ROOT, "unc", UNC)


@query("SELECT count(*) FILTER (WHERE page_id % 5 NOT IN (0, 2)) AS ok, count(*) AS total FROM pages")
def root_coverage(spark, sf_dir):
    return exports.coverage(_paths(spark, sf_dir), "path", ROOT)


LISTED = f"{TRACKS}, items AS (SELECT l_orderkey AS playlist, l_linenumber AS position, artist, title, album, artist || '/' || title || ':' || id || '.mp3' AS path, id FROM lineitem JOIN tracks ON id = l_partkey)"


def _listed(spark, sf_dir, made: Callable[[DataFrame], DataFrame] = lambda parts: parts) -> DataFrame:
    """Lines with their parts, with what ``made`` adds to each part."""
    parts = tracks(spark, sf_dir).select("id", "artist", "title", "album", F.concat("artist", F.lit("/"), "title", F.lit(":"), F.col("id").cast("string"), F.lit(".mp3")).alias("path"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("playlist"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("id"))
    return lines.join(made(parts), "id")


@query(f"""WITH {LISTED} SELECT playlist, ordinal::INT AS ordinal, path, lpad(ordinal::VARCHAR, greatest(2, len(count(*) OVER (PARTITION BY playlist)::VARCHAR))::INT, '0') || ' ' || artist || ' - ' || title || '.mp3' AS name
FROM (SELECT *, row_number() OVER (PARTITION BY playlist ORDER BY position, path) AS ordinal FROM items)""")
def copy_plan(spark, sf_dir):
    return exports.copy_plan(_listed(spark, sf_dir, exports.copy_names))


@query(f"""WITH {LISTED} SELECT playlist, ordinal::INT AS ordinal, path, artist || '/' || album || '/' || lpad(ordinal::VARCHAR, greatest(2, len(count(*) OVER (PARTITION BY playlist)::VARCHAR))::INT, '0') || ' ' || title || '.mp3' AS name
FROM (SELECT *, row_number() OVER (PARTITION BY playlist ORDER BY position, path) AS ordinal FROM items)""")
def copy_plan_tree(spark, sf_dir):
    return exports.copy_plan(_listed(spark, sf_dir, partial(exports.copy_names, tree=True)), tree=True)


PAIRS = """l AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey ORDER BY l_partkey) AS items FROM lineitem GROUP BY 1),
pairs AS (SELECT a.k, b.items AS wanted, a.items AS stored FROM l a JOIN l b ON b.k = a.k + 1 WHERE a.k % 2 = 0)"""


def _pairs(spark, sf_dir) -> DataFrame:
    """Each even list as stored, and the odd one after it as wanted."""
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_partkey")).alias("items"))
    wanted = lists.select((F.col("k") - 1).alias("k"), F.col("items").alias("wanted"))
    return lists.where("k % 2 = 0").select("k", F.col("items").alias("stored")).join(wanted, "k")


@query(f"WITH {PAIRS} SELECT k, list_concat(wanted, list_filter(stored, lambda x: NOT list_contains(wanted, x))) AS items FROM pairs")
def order_keeping_extras(spark, sf_dir):
    return _pairs(spark, sf_dir).select("k", exports.in_order(F.col("wanted"), F.col("stored")).alias("items"))


@query(f"WITH {PAIRS}, r AS (SELECT k, wanted, CASE WHEN k % 4 = 0 THEN list_reverse(wanted) ELSE list_concat(stored, wanted) END AS stored FROM pairs) SELECT k, list_filter(wanted, lambda x: list_contains(stored, x)) = list_filter(stored, lambda x: list_contains(wanted, x)) AS same FROM r")
def order_check(spark, sf_dir):
    stored = F.when(F.col("k") % 4 == 0, F.reverse("wanted")).otherwise(F.concat("stored", "wanted"))
    return _pairs(spark, sf_dir).select("k", exports.same_order(F.col("wanted"), stored).alias("same"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS item FROM lineitem WHERE l_orderkey % 2 = 0), w AS (SELECT DISTINCT l_orderkey - 1 AS k, l_partkey AS item FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT k, item, 'add' AS action FROM w ANTI JOIN s USING (k, item) UNION ALL SELECT k, item, 'remove' FROM s ANTI JOIN w USING (k, item)""")
def playlist_sync(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("item"))
    # dealt before they are made distinct: well packed files hold far more rows a task than one should group
    rows = lines.repartition(max(1, -(-lines.count() // ROWS)), "k", "item").distinct()
    return exports.changes(rows.where("k % 2 = 1").withColumn("k", F.col("k") - 1), rows.where("k % 2 = 0"), ["k", "item"], prune=True)


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY 1),
f AS (SELECT k, a, len(a) - 1 AS i, CASE WHEN k = 0 THEN 1 ELSE k END AS s FROM l
  UNION ALL SELECT k, list_transform(range(1, len(a) + 1), lambda x: a[CASE WHEN x = i + 1 THEN j + 1 WHEN x = j + 1 THEN i + 1 ELSE x END]), i - 1, t
  FROM (SELECT *, (s * 48271) % 2147483647 AS t, ((s * 48271) % 2147483647) % (i + 1) AS j FROM f WHERE i > 0))
SELECT k, arg_min(a, i) AS items FROM f GROUP BY k""")
def seeded_shuffle(spark, sf_dir):
    """Each order's parts, shuffled by the order's number."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(items.alias("items"))
    return lists.select("k", exports.shuffled(F.col("items"), F.col("k")).alias("items"))


@query(f"WITH {LISTED} SELECT playlist, id, row_number() OVER (PARTITION BY playlist ORDER BY lower(artist), lower(album), lower(title), position, id)::INT AS place FROM items")
def order_by_artist(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("playlist").orderBy(F.lower("artist"), F.lower("album"), F.lower("title"), "position", "id")
    return _listed(spark, sf_dir).select("playlist", "id", F.row_number().over(order).alias("place"))


@query("SELECT o_orderkey AS id, 'Mix ' || strftime(o_orderdate, '%y-%m-%d') || ' of ' || strftime(o_orderdate, '%B %Y') || ' {foo} ' || o_orderkey AS title FROM orders")
def playlist_titles(spark, sf_dir):
    title = text.title_of(F.lit(" Mix {date} of {month} {year} {foo} {seed}"), F.col("o_orderdate"), {"seed": F.col("o_orderkey")})
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), title.alias("title"))
