"""Mix requests over the vectors, with keys of songs and recordings made from the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mixes
from ..operators.mixes import Request
from .registry import POOL, pool, query, table

#: Plain quota, bans, duplicates and a line, a line that nothing meets, thinned by a coin, a collection.
PLAIN = [
    Request(1, 0), Request(2, 7, 20, bans=(3, 4, 5, 6), banned_artists=("3", " 5 ")), Request(3, 42, 15, 2, dedup=True), Request(4, 0, 20, line=0.12, floor_share=0.0, dedup=True),
    Request(5, 7, 20, line=0.99, floor_share=0.0), Request(6, 42, 20, line=0.1, floor_share=0.0, thin=2.0), Request(7, 0, 400, 0), Request(8, 7, 10, 1, line=0.2, floor_share=0.0, mask="early"), Request(9, 3, 5, line=0.9, floor_share=0.0, thin=50.0),
]
#: With a floor past the line, a re-pick for variety, and flow.
FULL = [Request(11, 0, 20, line=0.35), Request(12, 7, 12, line=0.3, variety=True, flow=True), Request(13, 42, 15, variety=True, bans=(1, 2)), Request(14, 3, 20, line=0.3, thin=3.0, floor_share=0.8), Request(15, 9, 10, flow=True, dedup=True)]


def song_pool(spark, sf_dir: str) -> DataFrame:
    rows = pool(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size")
    song = F.concat_ws("|", F.lower("artist"), F.substring_index("p_type", " ", 1))
    keys = {"twin": F.concat("artist", F.lit("|"), F.lower("p_type")), "recording": F.when(F.col("p_size") % 4 == 0, F.concat("p_brand", F.col("p_size").cast("string"))), "song": song, "early": F.col("p_size") <= 25}
    return rows.join(part, "id", "left").withColumns(keys).select("id", "artist", "vector", *keys)


def values(requests: list[Request]) -> str:
    one = lambda r: f"({r.number}, {r.seed}, {r.size}, {r.spacing}, {r.wanted}, {'NULL' if r.line is None else r.line}::DOUBLE, {1 / (1 + r.thin)}::DOUBLE, {r.thin > 0}, {r.dedup}, {r.mask is not None}, {list(r.bans)}::BIGINT[], {[a.strip().lower() for a in r.banned_artists]}::VARCHAR[])"
    return f"req(request, seed, size, spacing, wanted, line, keep, thinned, dedup, early_only, bans, blocked) AS (VALUES {', '.join(map(one, requests))})"


ROUTED = f"""{POOL}, {values(PLAIN)},
songs AS (SELECT pool.id, artist, v, artist || '|' || lower(p_type) AS twin, CASE WHEN p_size % 4 = 0 THEN p_brand || p_size END AS recording, concat_ws('|', lower(artist), split_part(p_type, ' ', 1)) AS song, coalesce(p_size <= 25, false) AS early
  FROM pool LEFT JOIN part ON p_partkey = pool.id),
scored AS (SELECT r.*, p.id, p.artist, p.twin, p.recording, p.song, s.twin AS seed_twin, s.recording AS seed_recording, s.song AS seed_song, round(list_dot_product(p.v, s.v), 9) AS score, list_dot_product(s.v, s.v) AS own
  FROM req r JOIN songs s ON s.id = r.seed JOIN songs p ON p.id <> r.seed AND (NOT r.early_only OR p.early)),
ranked AS (SELECT *, score / CASE WHEN own > 1e-9 THEN own ELSE 1 END AS fit, row_number() OVER (PARTITION BY request ORDER BY score DESC, id) AS rank,
  thinned AND ('0x' || substr(md5('coin:' || seed || ':' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= keep AS passed FROM scored),
walk AS (
  SELECT DISTINCT request, 0::BIGINT AS r, []::BIGINT[] AS ids, []::VARCHAR[] AS arts, [seed_twin] AS twins, [seed_recording] AS recs, 0::BIGINT AS skipped FROM ranked
  UNION ALL
  SELECT w.request, w.r + 1, CASE WHEN ok THEN list_append(ids, x.id) ELSE ids END, CASE WHEN ok THEN list_append(arts, x.artist) ELSE arts END,
    CASE WHEN ok THEN list_append(twins, x.twin) ELSE twins END, CASE WHEN ok THEN list_append(recs, x.recording) ELSE recs END, skipped + x.passed::INT
  FROM walk w JOIN ranked x ON x.request = w.request AND x.rank = w.r + 1,
    LATERAL (SELECT NOT x.passed AND NOT coalesce(list_contains(twins, x.twin), false) AND NOT coalesce(list_contains(recs, x.recording), false)
      AND NOT (x.artist <> '' AND list_contains(CASE WHEN x.spacing = 0 THEN arts ELSE arts[greatest(len(arts) - x.spacing + 1, 1):] END, x.artist)) AS ok) o
  WHERE len(ids) < x.wanted AND (x.line IS NULL OR x.fit >= x.line)),
last AS (SELECT request, max(r) AS reached, arg_max(ids, r) AS ids, arg_max(skipped, r) AS skipped FROM walk GROUP BY request),
taken AS (SELECT request, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS place FROM last),
left_over AS (SELECT x.*, t.place, row_number() OVER (PARTITION BY x.request, x.song ORDER BY t.place) AS copy FROM taken t JOIN ranked x USING (request, id)
  WHERE NOT list_contains(x.bans, x.id) AND NOT list_contains(x.blocked, lower(trim(x.artist)))),
listed AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY place) AS position FROM left_over WHERE NOT dedup OR copy = 1 AND song <> seed_song),
mix AS (SELECT * FROM listed WHERE position <= size),
stops AS (SELECT l.request, q.line, q.size AS requested, (SELECT count(*) FROM mix m WHERE m.request = l.request) AS returned, len(l.ids) AS walked, l.reached, l.skipped, len(l.ids) >= q.wanted AS full_walk,
  EXISTS (SELECT 1 FROM ranked x WHERE x.request = l.request AND x.rank = l.reached + 1 AND x.fit < q.line) AS below, (SELECT count(*) FROM ranked x WHERE x.request = l.request) AS pool
  FROM last l JOIN req q USING (request)),
reasons AS (SELECT *, CASE WHEN line IS NULL THEN 'quota' WHEN returned >= requested THEN 'size' WHEN returned = 0 AND skipped > 0 THEN 'thinned' WHEN returned = 0 AND below AND NOT full_walk THEN 'none_fit'
  WHEN returned = 0 THEN 'empty' WHEN full_walk THEN 'trimmed' WHEN below THEN 'fit' ELSE 'exhausted' END AS reason FROM stops)"""


@query(f"WITH RECURSIVE {ROUTED} SELECT request, position::INT AS position, id, rank::INT AS rank, score, round(fit, 9) AS fit FROM mix")
def mix_lists(spark, sf_dir):
    """The lists of nine requests: a seed's own song never comes again, nor one recording twice."""
    field, _ = mixes.answers(song_pool(spark, sf_dir), PLAIN)
    return mixes.delivered(field).select("request", "position", "id", "rank", "score", F.round("fit", 9).alias("fit"))


@query(f"WITH RECURSIVE {ROUTED} SELECT request, reason, requested::INT AS requested, returned::INT AS returned, walked::INT AS walked, reached::INT AS reached, skipped::INT AS passed_over, pool FROM reasons")
def mix_stops(spark, sf_dir):
    """Why each list has its length."""
    _, stops = mixes.answers(song_pool(spark, sf_dir), PLAIN)
    return stops.select("request", "reason", "requested", "returned", "walked", "reached", "passed_over", "pool")


@query(f"""WITH RECURSIVE {ROUTED}, d AS (SELECT *, CASE reason WHEN 'fit' THEN 'line' WHEN 'none_fit' THEN 'line' WHEN 'thinned' THEN 'walk' WHEN 'exhausted' THEN 'pool' WHEN 'empty' THEN 'pool' WHEN 'trimmed' THEN 'after' ELSE 'result' END AS decider FROM reasons)
SELECT request, unnest(range(1, 6))::INT AS place, unnest(['pool', 'walk', 'line', 'after', 'result']) AS stage, unnest([pool, reached, CASE WHEN line IS NOT NULL THEN walked END, returned, returned])::BIGINT AS n,
  unnest(list_transform(['pool', 'walk', 'line', 'after', 'result'], lambda s: s = decider)) AS decides FROM d""")
def mix_stages(spark, sf_dir):
    """The funnel of each request, and the stage that decided where its list ended."""
    _, stops = mixes.answers(song_pool(spark, sf_dir), PLAIN)
    return mixes.trace_stages(stops)


@query()
def mix_routes(spark, sf_dir):
    """What became of each candidate of requests with floors, variety and flow."""
    field, _ = mixes.answers(song_pool(spark, sf_dir), FULL)
    return mixes.trace_field(field)
