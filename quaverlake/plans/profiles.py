"""Scores with all terms under profiles and overrides, over the vectors and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import profiles, scoring
from .registry import POOL, TRACKS, pool, query, table, tracks

SEEDS = [0, 7, 42, 60]
V2 = profiles.overridden(profiles.settings(weights={"key": 0.2, "artist": 0.12}, family_credit=0.5), {"loud": "0.25", "lib": "9", "bpm": "x"})
SOUND = profiles.settings(trained=True, has_head=True, weights={"earfeel": 0.0, "key": 0.1})


def scored_pool(spark, sf_dir: str) -> DataFrame:
    """Vectors with a descriptor of 24 z-scored components, tags, families, tempo, key, year, loudness and artist id."""
    rows = pool(spark, sf_dir)
    tail = rows.select("id", F.slice("vector", 41, 24).alias("tail"))
    stats = vectors.dimension_stats(tail, "tail")
    described = tail.crossJoin(F.broadcast(stats)).select("id", vectors.unit(vectors.z_scored(F.col("tail"), F.col("mean"), F.col("std"))).alias("descriptor"))
    tagged = tracks(spark, sf_dir).select("id", F.col("genres").alias("tags"), F.array(F.substring_index("family", " ", 1)).alias("families"), "bpm", "year")
    key = F.struct((F.floor(F.col("id") / 2) % 12).cast("int").alias("tonic"), (F.col("id") % 2 == 0).alias("major"))
    known = {"key": F.when(F.col("id") % 7 > 0, key), "lufs": F.when(F.col("id") % 10 > 0, -6.0 - 1.5 * (F.col("id") % 9)), "artist_id": F.when(F.col("id") % 6 > 0, F.col("id") % 25)}
    return rows.join(described, "id").join(tagged, "id", "left").withColumns(known)


def nation_edges(spark, sf_dir: str) -> DataFrame:
    """Edges between 25 artist ids, from the nations that customers and suppliers have."""
    sides = [table(spark, sf_dir, t).select(F.col(c).alias(n)).distinct() for t, c, n in (("customer", "c_nationkey", "a"), ("supplier", "s_nationkey", "b"))]
    return sides[0].join(sides[1], (F.col("a") != F.col("b")) & ((F.col("a") + F.col("b")) % 7 == 0)).select("a", "b", (1.0 / (1 + F.abs(F.col("a") - F.col("b")))).alias("score"))


def pairs(spark, sf_dir: str) -> DataFrame:
    return profiles.artist_affinity(scoring.seed_pairs(scored_pool(spark, sf_dir), SEEDS), nation_edges(spark, sf_dir))


TERMS8 = f"""{POOL}, {TRACKS},
tails AS (SELECT id, unnest(range(24)) AS d, unnest(v[41:64]) AS x FROM pool),
zs AS (SELECT id, d, (x - avg(x) OVER (PARTITION BY d)) / greatest(stddev_pop(x) OVER (PARTITION BY d), 1e-9) AS z FROM tails),
descs AS (SELECT id, list(z ORDER BY d) AS l FROM zs GROUP BY id),
rows AS (SELECT p.id, p.v, l, t.genres AS tags, split_part(t.family, ' ', 1) AS fam, t.bpm, t.year, CASE WHEN p.id % 7 > 0 THEN p.id // 2 % 12 END AS tonic, p.id % 2 = 0 AS major,
  CASE WHEN p.id % 10 > 0 THEN -6.0::DOUBLE - 1.5::DOUBLE * (p.id % 9) END AS lufs, CASE WHEN p.id % 6 > 0 THEN p.id % 25 END AS aid FROM pool p JOIN descs USING (id) LEFT JOIN tracks t USING (id)),
e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b, 1.0::DOUBLE / (1 + abs(c_nationkey - s_nationkey)) AS score FROM customer JOIN supplier ON c_nationkey <> s_nationkey AND (c_nationkey + s_nationkey) % 7 = 0),
u AS (SELECT a, b, max(score) AS score FROM (SELECT a, b, score FROM e UNION ALL SELECT b, a, score FROM e) GROUP BY a, b),
j AS (SELECT s.id AS seed_id, p.id, p.v, s.v AS sv, p.l, s.l AS sl, coalesce(len(list_intersect(p.tags, s.tags)) / len(list_distinct(list_concat(p.tags, s.tags))), 0)::DOUBLE AS jac, coalesce(p.fam = s.fam, false) AS fam,
  p.bpm, s.bpm AS sbpm, p.year, s.year AS syear, p.tonic, s.tonic AS stonic, p.major, s.major AS smajor, p.lufs, s.lufs AS slufs, p.aid, s.aid AS said, u.score AS edge
  FROM rows p JOIN rows s ON s.id IN (0, 7, 42, 60) LEFT JOIN u ON u.a = s.aid AND u.b = p.aid),
terms AS (SELECT seed_id, id, round(list_dot_product(v, sv), 9) AS clap, round(list_cosine_similarity(l, sl), 9) AS lib,
  round(jac + CASE WHEN fam THEN {{credit}} * (1 - jac) ELSE 0 END, 9) AS genre,
  round(-CASE WHEN coalesce(bpm, 0) = 0 OR coalesce(sbpm, 0) = 0 THEN 0.5 ELSE abs(bpm - sbpm) / 40.0::DOUBLE END, 9) AS bpm,
  round(-CASE WHEN coalesce(year, 0) = 0 OR coalesce(syear, 0) = 0 THEN 0.5 ELSE abs(year - syear) / 25.0::DOUBLE END, 9) AS era,
  CASE WHEN stonic IS NOT NULL THEN CASE WHEN tonic IS NULL THEN 0.5 WHEN major = smajor THEN CASE (tonic - stonic + 12) % 12 WHEN 0 THEN 1.0 WHEN 5 THEN 0.8 WHEN 7 THEN 0.8 WHEN 2 THEN 0.4 WHEN 10 THEN 0.4 ELSE 0.0 END
    WHEN ((CASE WHEN smajor THEN tonic ELSE stonic END) + 3) % 12 = (CASE WHEN smajor THEN stonic ELSE tonic END) THEN 0.8 ELSE 0.0 END::DOUBLE END AS key,
  round(CASE WHEN said IS NOT NULL THEN CASE WHEN said = aid THEN 1.0 ELSE coalesce(edge, 0) END::DOUBLE END, 9) AS artist,
  round(-CASE WHEN lufs IS NULL OR slufs IS NULL THEN 0.5 ELSE abs(lufs - slufs) / 10.0::DOUBLE END, 9) AS loud FROM j)"""
RAW8 = "1.0::DOUBLE * clap + 5.0::DOUBLE * lib + 0.3::DOUBLE * genre + 0.3::DOUBLE * bpm + 0.1::DOUBLE * era + 0.2::DOUBLE * coalesce(key, 0) + 0.12::DOUBLE * coalesce(artist, 0) + 0.25::DOUBLE * loud"
Z8 = "coalesce({1} * CASE WHEN stddev_pop({0}) OVER w > 1e-12 THEN ({0} - avg({0}) OVER w) / stddev_pop({0}) OVER w WHEN {0} IS NOT NULL THEN 0 END, 0)"


@query(f"WITH {TERMS8.format(credit='0.5::DOUBLE')} SELECT seed_id, id, round({RAW8}, 4) AS score FROM terms")
def profile_v2(spark, sf_dir):
    """The default profile with all eight terms, a family credit, and weights moved by a request: lib is held at 5, a word for bpm is passed over."""
    return profiles.score(pairs(spark, sf_dir), V2).select("seed_id", "id", F.round("score", 4).alias("score"))


@query(f"""WITH {TERMS8.format(credit='0.0::DOUBLE')} SELECT seed_id, id, round({' + '.join(Z8.format(t, w) for t, w in (('clap', 1.0), ('genre', 0.2), ('era', 1.5), ('key', 0.1), ('artist', 0.12)))}, 5) AS score
FROM terms WINDOW w AS (PARTITION BY seed_id)""")
def profile_sound(spark, sf_dir):
    """The profile of a library with trained fingerprints: z-scores of five terms; a term that the seed has no value for adds nothing."""
    return profiles.score(pairs(spark, sf_dir), SOUND).select("seed_id", "id", F.round("score", 5).alias("score"))


@query(f"""WITH {TERMS8.format(credit='0.5::DOUBLE')} SELECT seed_id, id, term, round(value, 4) + 0.0::DOUBLE AS value FROM (SELECT seed_id, id, unnest(['clap', 'lib', 'genre', 'bpm', 'era', 'key', 'artist', 'loud']) AS term,
  unnest([clap, 5.0::DOUBLE * lib, 0.3::DOUBLE * genre, 0.3::DOUBLE * bpm, 0.1::DOUBLE * era, 0.2::DOUBLE * coalesce(key, 0), 0.12::DOUBLE * coalesce(artist, 0), 0.25::DOUBLE * loud]) AS value FROM terms)""")
def explain_profile(spark, sf_dir):
    """Each term's share of the score of ``profile_v2``."""
    parts = profiles.score(pairs(spark, sf_dir), V2)
    named = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"c_{t}").alias("value")) for t in V2.active])
    return parts.select("seed_id", "id", F.explode(named).alias("x")).select("seed_id", "id", "x.term", (F.round("x.value", 4) + F.lit(0.0)).alias("value"))


@query(f"""WITH {TRACKS}, r AS (SELECT id, bpm AS rms, CASE WHEN id % 3 > 0 THEN -6.0::DOUBLE - 1.5::DOUBLE * (id % 9) END AS lufs FROM tracks),
f AS (SELECT regr_slope(lufs, 20 * log10(rms)) AS a, regr_intercept(lufs, 20 * log10(rms)) AS b FROM r WHERE lufs IS NOT NULL AND rms > 0),
i AS (SELECT id, coalesce(lufs, CASE WHEN rms > 0 THEN a * 20 * log10(rms) + b END) AS loudness FROM r, f),
z AS (SELECT id, (loudness - avg(loudness) OVER ()) / stddev_pop(loudness) OVER () AS z FROM i)
SELECT id, round(z, 6) AS energy, round(lo, 6) AS low, round(hi, 6) AS high FROM z, (SELECT quantile_cont(z, 0.1) AS lo, quantile_cont(z, 0.9) AS hi FROM z)""")
def loudness_energy(spark, sf_dir):
    """The energy axis from measured loudness, what is not measured from a line over the level; rows with neither stay null."""
    rows = tracks(spark, sf_dir).select("id", F.col("bpm").alias("rms"), F.when(F.col("id") % 3 > 0, -6.0 - 1.5 * (F.col("id") % 9)).alias("lufs"))
    filled = profiles.imputed_loudness(rows).select("id", "loudness")
    stats = filled.agg(F.avg("loudness").alias("m"), F.stddev_pop("loudness").alias("s"), F.percentile("loudness", F.array(F.lit(0.1), F.lit(0.9))).alias("p"))
    spread = F.greatest(F.col("s"), F.lit(1e-9))
    ends = [F.round((F.element_at("p", k) - F.col("m")) / spread, 6).alias(n) for k, n in ((1, "low"), (2, "high"))]
    return filled.crossJoin(F.broadcast(stats)).select("id", F.round((F.col("loudness") - F.col("m")) / spread, 6).alias("energy"), *ends)
