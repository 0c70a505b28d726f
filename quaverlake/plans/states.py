"""Queries on what is stored, fresh, failed or to do: parts as tracks, with made-up analysis states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge, states
from .registry import query, table

STATES = """t AS (SELECT p_partkey AS path, CASE WHEN p_size % 10 <> 0 THEN p_size END AS mtime FROM part),
f AS (SELECT p_partkey AS path, CASE WHEN p_size > 10 THEN p_size END AS vec, CASE WHEN p_size <= 5 THEN 'no decoder: x' WHEN p_size <= 8 THEN 'too short: 3 s' WHEN p_size <= 10 THEN 'damaged' END AS error,
  CASE WHEN p_partkey % 7 > 0 THEN p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END END AS src_mtime FROM part WHERE p_partkey % 4 > 0)"""


def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Tracks and their features."""
    part, size, key = table(spark, sf_dir, "part"), F.col("p_size"), F.col("p_partkey")
    tracks = part.select(key.alias("path"), F.when(size % 10 != 0, size).alias("mtime"))
    error = F.when(size <= 5, "no decoder: x").when(size <= 8, "too short: 3 s").when(size <= 10, "damaged")
    seen = F.when(key % 7 > 0, size + F.when(key % 5 == 0, 1).otherwise(0))
    return tracks, part.where(key % 4 > 0).select(key.alias("path"), F.when(size > 10, size).alias("vec"), error.alias("error"), seen.alias("src_mtime"))


@query(f"WITH {STATES} SELECT path FROM f JOIN t USING (path) WHERE (vec IS NOT NULL OR error IS NOT NULL) AND (src_mtime IS NULL OR mtime IS NULL OR src_mtime = mtime)")
def up_to_date(spark, sf_dir):
    tracks, features = _states(spark, sf_dir)
    return states.up_to_date(features, tracks)


@query(f"WITH {STATES} SELECT path, CASE WHEN error LIKE 'no decoder:%' THEN 'decoder now present' ELSE 'second decoder now asked' END AS why FROM f WHERE error LIKE 'no decoder:%' OR error LIKE 'too short%'")
def retry_selection(spark, sf_dir):
    return states.to_retry(_states(spark, sf_dir)[1], decoder=True)


@query(f"WITH {STATES} SELECT t.path, t.mtime FROM t LEFT JOIN (SELECT path, src_mtime, error, true AS known FROM f) f USING (path) WHERE known IS NULL OR src_mtime IS DISTINCT FROM mtime OR error IS NOT NULL")
def loudness_todo(spark, sf_dir):
    tracks, features = _states(spark, sf_dir)
    return states.to_measure(tracks, features, retry_errors=True)


@query(f"WITH {STATES} SELECT path, vec FROM f WHERE error IS NULL")
def clear_failed(spark, sf_dir):
    return states.cleared(_states(spark, sf_dir)[1], only_failed=True).select("path", "vec")


@query(f"WITH {STATES} SELECT count(*) AS waiting FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.path = t.path AND vec IS NOT NULL)")
def waiting_count(spark, sf_dir):
    tracks, features = _states(spark, sf_dir)
    return tracks.join(features.where("vec IS NOT NULL"), "path", "left_anti").agg(F.count(F.lit(1)).alias("waiting"))


FILES = "files AS (SELECT vec_id AS path, CASE WHEN label % 3 = 0 THEN 1 ELSE 0 END AS missing FROM embeddings), again AS (SELECT vec_id AS path, (label % 2)::INT AS missing FROM embeddings WHERE vec_id % 2 = 0)"


def _files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), "label")
    files = rows.select("path", F.when(F.col("label") % 3 == 0, 1).otherwise(0).alias("missing"))
    return files, rows.where("path % 2 = 0").select("path", (F.col("label") % 2).cast("int").alias("missing"))


@query(f"WITH {FILES} SELECT path, coalesce(a.missing, f.missing) AS missing FROM files f LEFT JOIN again a USING (path)")
def missing_flags(spark, sf_dir):
    """Flags of a new check over those of older ones."""
    return merge.upsert(*_files(spark, sf_dir), "path")


@query(f"WITH {FILES} SELECT vec_id AS path FROM embeddings WHERE vec_id NOT IN (SELECT path FROM files WHERE missing = 1)")
def verified_pool(spark, sf_dir):
    files, _ = _files(spark, sf_dir)
    return states.present(files.select("path"), files)


@query("SELECT p_partkey AS path, CASE WHEN p_size % 3 = 0 OR p_size IS NULL THEN p_partkey * 10 ELSE p_size END::BIGINT AS date_added FROM part")
def backfill_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")).otherwise(0).cast("long").alias("date_added"), (F.col("p_partkey") * 10).alias("mtime"))
    return states.backfilled(rows, "date_added", "mtime").select("path", "date_added")


@query("""WITH n AS (SELECT l_partkey AS path, arg_max(l_quantity, row(l_orderkey, l_linenumber)) AS bitrate FROM lineitem GROUP BY 1)
SELECT p_partkey AS path, coalesce(bitrate, p_size)::DOUBLE AS bitrate FROM part LEFT JOIN n ON path = p_partkey""")
def header_upsert(spark, sf_dir):
    """Headers read again and again: the last reading of each path replaces the stored row."""
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("double").alias("bitrate"))
    new = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_quantity").cast("double").alias("bitrate"), F.struct("l_orderkey", "l_linenumber").alias("seq"))
    return merge.upsert(base, new, "path")


@query("SELECT vec_id AS id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS ok FROM embeddings")
def descriptor_validity(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), states.descriptor_ok(F.col("embedding"), 64).alias("ok"))


PLACES = "places AS (SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'Like-' || page_id || '.m3u8' WHEN 1 THEN '_Similar To\\x' || page_id WHEN 2 THEN 'a\\top-like-' || page_id ELSE 'mine/' || page_id END AS path FROM pages)"


@query(f"WITH {PLACES} SELECT id, CASE WHEN id % 4 < 3 THEN 'machine_similarity' ELSE 'curated_or_unknown' END AS kind FROM places")
def list_provenance(spark, sf_dir):
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("Like-"), n, F.lit(".m3u8"))).when(k == 1, F.concat(F.lit("_Similar To\\x"), n)).when(k == 2, F.concat(F.lit("a\\top-like-"), n)).otherwise(F.concat(F.lit("mine/"), n))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), states.provenance(path).alias("kind"))


@query("SELECT doc_id, regexp_matches(lower(text), 'singles & loose tracks|loose tracks|b-sides|b sides|bootleg|unknown album|various artists|compilation') AS placeholder FROM documents WHERE text IS NOT NULL")
def placeholder_albums(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", states.is_placeholder(F.col("text")).alias("placeholder"))


@query("SELECT page_id AS id, page_id % 3 = 1 AS outside FROM pages")
def excluded_subtree(spark, sf_dir):
    """Folders that are left out, whatever their case and separators; a sibling of a like name stays."""
    n = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("M:\\music\\ABTest\\"), n)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("m:/music/abtest 2/"), n)).otherwise("m:/Music/Old")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), states.outside_subtree(path, ["M:/Music/ABTest", "M:\\Music\\Old\\"]).alias("outside"))
