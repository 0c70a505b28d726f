"""Queries on vectors: scores, lists and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import lists, ranks, scoring
from .registry import POOL, TRACKS, pool, query, table, tracks, walk_sql

SEEDS = [0, 7, 42]


def seed_scores(rows: DataFrame, seeds: list[int], digits: int = 9) -> DataFrame:
    pairs = scoring.seed_pairs(rows, seeds).where("id <> seed_id")
    return pairs.select("seed_id", "id", "artist", F.round(vectors.dot(F.col("vector"), F.col("seed_vector")), digits).alias("score"))


def seed_pool_scores(rows: DataFrame, seeds: DataFrame, digits: int = 9) -> DataFrame:
    """Scores of every row of the pool for each row of ``seeds``; pairs of a seed travel by seed."""
    chosen = seeds.select(F.col("id").alias("seed_id"), F.col("vector").alias("seed_vector"))
    return rows.crossJoin(chosen).where("id <> seed_id").select("seed_id", "id", "artist", F.round(vectors.dot(F.col("vector"), F.col("seed_vector")), digits).alias("score"))


def ranked_sql(seeds=SEEDS, where: str = "p.id <> s.id", score: str = "round(list_dot_product(p.v, s.v), 9)") -> str:
    return f"""{POOL},
scored AS (SELECT s.id AS seed_id, p.id, p.artist, {score} AS score FROM pool p JOIN pool s ON s.id IN ({', '.join(map(str, seeds))}) AND {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, id) AS rank FROM scored)"""


@query(walk_sql(ranked_sql([0]), 25, 3))
def spaced_mix(spark, sf_dir):
    """25 nearest to seed 0 with artist spacing 3."""
    return lists.filled_walk(seed_scores(pool(spark, sf_dir), [0]), 25, 3)


@query(walk_sql(ranked_sql(), 20, 2))
def spaced_mixes(spark, sf_dir):
    return lists.filled_walk(seed_scores(pool(spark, sf_dir), SEEDS), 20, 2)


@query(walk_sql(ranked_sql(), 25, 0))
def unspaced_mix_each_artist_once(spark, sf_dir):
    """Spacing 0 looks back over the whole list."""
    return lists.filled_walk(seed_scores(pool(spark, sf_dir), SEEDS), 25, 0)


@query(f"WITH {ranked_sql()} SELECT seed_id, id, score, rank::INT AS rank FROM ranked WHERE rank <= 50")
def nearest_k(spark, sf_dir):
    return lists.ranked(seed_scores(pool(spark, sf_dir), SEEDS), 50).select("seed_id", "id", "score", "rank")


STYLE = 40
GROUP_WEIGHTS = [2.5 - 1.5 * STYLE / 100] * 40 + [0.6 + 0.5 * STYLE / 100] * 23 + [0.4 + 0.6 * STYLE / 100]
DISTANCE = f"sqrt(list_sum(list_transform(range(1, 65), lambda i: power((p.v[i] - s.v[i]) * ({GROUP_WEIGHTS})[i], 2))))"


@query(f"WITH {ranked_sql(score=f'-round({DISTANCE}, 9)')} SELECT seed_id, id, -score AS distance, rank::INT AS rank FROM ranked WHERE rank <= 40")
def weighted_euclidean_k(spark, sf_dir):
    pairs = scoring.seed_pairs(pool(spark, sf_dir), SEEDS).where("id <> seed_id")
    far = pairs.select("seed_id", "id", (-F.round(vectors.weighted_distance(F.col("vector"), F.col("seed_vector"), GROUP_WEIGHTS), 9)).alias("score"))
    return lists.ranked(far, 40).select("seed_id", "id", (-F.col("score")).alias("distance"), "rank")


Z_POOL = """pool AS (
  SELECT id, artist, list(z ORDER BY d) AS v FROM (
    SELECT id, artist, d, (x - avg(x) OVER (PARTITION BY d)) / greatest(stddev_pop(x) OVER (PARTITION BY d), 1e-9) AS z FROM (
      SELECT vec_id AS id, label::VARCHAR AS artist, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)) GROUP BY id, artist)"""
COSINE = "round(list_cosine_similarity(p.v, s.v), 6)"


@query(f"WITH {ranked_sql(score=COSINE).replace(POOL, Z_POOL)} SELECT seed_id, id, score FROM ranked WHERE rank <= 40 OR score > 0.3")
def descriptor_cosine(spark, sf_dir):
    """Cosine after z-scores over all rows."""
    rows = pool(spark, sf_dir)
    stats = vectors.dimension_stats(rows, "vector")
    z = rows.crossJoin(F.broadcast(stats)).withColumn("vector", vectors.unit(vectors.z_scored(F.col("vector"), F.col("mean"), F.col("std")))).drop("mean", "std")
    near = seed_scores(z, SEEDS, 6)
    return lists.ranked(near).where("rank <= 40 OR score > 0.3").select("seed_id", "id", "score")


C_POOL = Z_POOL.replace("/ greatest(stddev_pop(x) OVER (PARTITION BY d), 1e-9)", "")


@query(f"WITH {ranked_sql(score=COSINE).replace(POOL, C_POOL)} SELECT seed_id, id, score FROM ranked WHERE rank <= 40")
def centered_space(spark, sf_dir):
    rows = pool(spark, sf_dir)
    centred = rows.crossJoin(F.broadcast(vectors.centroid(rows, "vector"))).withColumn("vector", vectors.unit(vectors.less(F.col("vector"), F.col("centroid")))).drop("centroid")
    near = seed_scores(centred, SEEDS, 6)
    return lists.ranked(near, 40).select("seed_id", "id", "score")


@query()
def all_but_the_top(spark, sf_dir):
    """Scores with the pool's two top directions removed."""
    return lists.ranked(seed_scores(scoring.without_top(pool(spark, sf_dir), 2), SEEDS), 40)


@query(f"WITH {POOL} SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 6) AS cosine FROM pool a JOIN pool b ON a.id < b.id AND round(list_dot_product(a.v, b.v), 9) >= 0.4")
def near_duplicates(spark, sf_dir):
    return scoring.similar_pairs(pool(spark, sf_dir), 0.4).withColumn("cosine", F.round("cosine", 6))


KNN = f"""{POOL}, near AS (
  SELECT id, neighbour, cosine, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour) AS rank FROM (
    SELECT a.id, b.id AS neighbour, round(list_dot_product(a.v, b.v), 9) AS cosine FROM pool a JOIN pool b ON a.id <> b.id))"""


@query(f"""WITH {KNN}, top AS (SELECT * FROM near WHERE rank <= 10),
n AS (SELECT p.id, count(t.id) AS occurrences FROM pool p LEFT JOIN top t ON t.neighbour = p.id GROUP BY p.id)
SELECT max(occurrences) AS most, count(*) FILTER (WHERE occurrences = 0) AS never, count(*) FILTER (WHERE occurrences > 0.02 * (SELECT count(*) FROM pool)) AS hubs,
       round(avg(power((occurrences - m) / s, 3)), 6) AS skew
FROM n, (SELECT avg(occurrences) AS m, stddev_pop(occurrences) AS s FROM n)""")
def hubness(spark, sf_dir):
    rows = pool(spark, sf_dir)
    top = scoring.nearest(rows, 10)
    n = rows.select("id").join(top.groupBy(F.col("neighbour").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    size = n.agg(F.count(F.lit(1)).alias("size"))
    return n.crossJoin(F.broadcast(size)).agg(
        F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("never"), F.count_if(F.col("n") > 0.02 * F.col("size")).alias("hubs"), F.round(F.skewness("n"), 6).alias("skew")
    )


@query(f"""WITH {KNN}, r AS (SELECT id, avg(cosine) AS r FROM near WHERE rank <= 10 GROUP BY id)
SELECT n.id, n.neighbour, round(2 * n.cosine - r.r, 6) AS csls FROM near n JOIN r ON r.id = n.neighbour WHERE n.rank <= 5""")
def csls(spark, sf_dir):
    """Cosines of the nearest, corrected for how near the neighbour is to others."""
    top = scoring.nearest(pool(spark, sf_dir), 10)
    r = top.groupBy(F.col("id").alias("neighbour")).agg(F.avg("cosine").alias("r"))
    return top.where("rank <= 5").join(r, "neighbour").select("id", "neighbour", F.round(2 * F.col("cosine") - F.col("r"), 6).alias("csls"))


CENTRE = """centre AS (SELECT list(m ORDER BY d) AS c FROM (SELECT d, avg(x) AS m FROM (SELECT unnest(range(64)) AS d, unnest(v) AS x FROM pool WHERE id IN (0, 1, 2)) GROUP BY d)),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
  SELECT 0 AS seed_id, p.id, p.artist, round(list_dot_product(p.v, c.c) / sqrt(list_dot_product(c.c, c.c)), 6) AS score FROM pool p, centre c WHERE p.id NOT IN (0, 1, 2)))"""


@query(walk_sql(f"{POOL}, {CENTRE}", 25, 3))
def blend_mix(spark, sf_dir):
    rows = pool(spark, sf_dir)
    centre = vectors.centroid(rows.where(F.col("id").isin(0, 1, 2)), "vector").select(vectors.unit(F.col("centroid")).alias("q"))
    scores = rows.where(~F.col("id").isin(0, 1, 2)).crossJoin(F.broadcast(centre))
    scores = scores.select(F.lit(0).alias("seed_id"), "id", "artist", F.round(vectors.dot(F.col("vector"), F.col("q")), 6).alias("score"))
    return lists.filled_walk(scores, 25, 3)


@query(f"WITH {POOL} SELECT round(avg(list_dot_product(a.v, b.v)), 6) AS cohesion FROM pool a JOIN pool b ON a.id <> b.id AND a.id IN (0, 1, 2) AND b.id IN (0, 1, 2)")
def cohesion(spark, sf_dir):
    few = pool(spark, sf_dir).where(F.col("id").isin(0, 1, 2))
    return scoring.seed_pairs(few, [0, 1, 2]).where("id <> seed_id").agg(F.round(F.avg(vectors.dot(F.col("vector"), F.col("seed_vector"))), 6).alias("cohesion"))


MEANS = "(SELECT list(m ORDER BY d) AS c FROM (SELECT d, avg(x) AS m FROM (SELECT unnest(range(64)) AS d, unnest(v) AS x FROM pool WHERE id IN ({0})) GROUP BY d))"
REFINED = f"""q AS (SELECT list_transform(range(1, 65), lambda i: s.v[i] + 0.75 * l.c[i] - 0.15 * k.c[i]) AS q
  FROM (SELECT v FROM pool WHERE id = 0) s, {MEANS.format('3, 4')} l, {MEANS.format('5, 6')} k),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
  SELECT 0 AS seed_id, p.id, p.artist, round(list_dot_product(p.v, q.q) / sqrt(list_dot_product(q.q, q.q)), 6) AS score FROM pool p, q WHERE p.id NOT IN (0, 3, 4, 5, 6)))"""


@query(walk_sql(f"{POOL}, {REFINED}", 25, 3))
def refine_mix(spark, sf_dir):
    """Seed 0 steered toward 3 and 4 and away from 5 and 6."""
    rows = pool(spark, sf_dir)
    part = lambda ids, name: vectors.centroid(rows.where(F.col("id").isin(*ids)), "vector").select(F.col("centroid").alias(name))
    q = rows.where("id = 0").select(F.col("vector").alias("base")).crossJoin(part([3, 4], "liked")).crossJoin(part([5, 6], "disliked"))
    q = q.select(lists.steered(F.col("base"), F.col("liked"), F.col("disliked")).alias("q"))
    scores = rows.where(~F.col("id").isin(0, 3, 4, 5, 6)).crossJoin(F.broadcast(q))
    return lists.filled_walk(scores.select(F.lit(0).alias("seed_id"), "id", "artist", F.round(vectors.dot(F.col("vector"), F.col("q")), 6).alias("score")), 25, 3)


@query(f"""WITH RECURSIVE {ranked_sql([0])}, c AS (SELECT r.id, r.score, p.v FROM ranked r JOIN pool p USING (id) WHERE rank <= 60),
m AS (
  SELECT 1::BIGINT AS position, [id] AS ids FROM c WHERE id = (SELECT arg_max(id, row(score, -id)) FROM c)
  UNION ALL
  SELECT m.position + 1, list_append(m.ids, (
    SELECT arg_max(x.id, row(x.value, x.score, -x.id)) FROM (
      SELECT c.id, c.score, round(0.3 * c.score - 0.7 * max(round(list_dot_product(c.v, d.v), 9)), 9) AS value
      FROM c JOIN c d ON list_contains(m.ids, d.id) WHERE NOT list_contains(m.ids, c.id) GROUP BY c.id, c.score) x))
  FROM m WHERE m.position < 10)
SELECT 0::BIGINT AS seed_id, ids[position] AS id, (SELECT score FROM c WHERE c.id = ids[position]) AS score, position::INT AS position FROM m""")
def mmr_rerank(spark, sf_dir):
    rows = pool(spark, sf_dir)
    head = lists.ranked(seed_scores(rows, [0]), 60)
    return lists.diverse(head.join(rows.select("id", "vector"), "id"), 10, 0.3).select("seed_id", "id", "score", "position")


@query(f"""WITH RECURSIVE {ranked_sql([0])}, c AS (SELECT r.rank, r.id, p.v FROM ranked r JOIN pool p USING (id) WHERE rank <= 25),
m AS (
  SELECT 1::BIGINT AS position, [id] AS ids FROM c WHERE rank = 1
  UNION ALL
  SELECT m.position + 1, list_append(m.ids, (
    SELECT arg_max(c.id, row(round(list_dot_product(c.v, l.v), 9), -c.id)) FROM c, c l WHERE l.id = m.ids[m.position] AND NOT list_contains(m.ids, c.id)))
  FROM m WHERE m.position < 25)
SELECT 0::BIGINT AS seed_id, position::INT AS position, ids[position] AS id FROM m""")
def flow_order(spark, sf_dir):
    rows = pool(spark, sf_dir)
    head = lists.ranked(seed_scores(rows, [0]), 25).select("seed_id", F.col("rank").alias("position"), "id")
    return lists.by_flow(head.join(rows.select("id", "vector"), "id"))


TOSS = "('0x' || substr(md5('radio:' || seed_id || ':' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(walk_sql(f"""{ranked_sql().replace('ranked AS', 'all_ranked AS')},
kept AS (SELECT * FROM all_ranked WHERE {TOSS} < 1.0::DOUBLE / 1.5::DOUBLE),
ranked AS (SELECT seed_id, id, artist, score, row_number() OVER (PARTITION BY seed_id ORDER BY rank) AS rank FROM kept)""", 20, 3, "seed_id, position, id, score"))
def radio_batch(spark, sf_dir):
    """A queue with a coin a candidate at variety 0.5."""
    return lists.radio(lists.ranked(seed_scores(pool(spark, sf_dir), SEEDS)), 20, 3, 0.5).select("seed_id", "position", "id", "score")


@query()
def radio_wave(spark, sf_dir):
    """A queue whose energy follows a wave."""
    rows = pool(spark, sf_dir)
    energy = rows.select("id", F.element_at("vector", 1).alias("energy"))
    return lists.radio(lists.ranked(seed_scores(rows, SEEDS)).join(energy, "id"), 20, 3, 0.5, "wave", energy="energy")


@query()
def adventure_path(spark, sf_dir):
    return lists.adventure(pool(spark, sf_dir), 0, 42, 12)


@query()
def walk_reports(spark, sf_dir):
    """What each of three walks does with every candidate it reaches."""
    return lists.walk_report(lists.ranked(seed_scores(pool(spark, sf_dir), SEEDS)), 20, 3, line=0.25, floor=10)


@query(f"""WITH {POOL}, s AS (SELECT p.id, round(list_dot_product(p.v, d.v), 9) AS s FROM pool p, pool d WHERE d.id = 1)
SELECT id, s AS score, round((rank() OVER (ORDER BY s) - 1 + (count(*) OVER (PARTITION BY s) - 1) / 2.0) / (count(*) OVER () - 1), 9)::DOUBLE AS percentile FROM s""")
def sensation_percentile(spark, sf_dir):
    """Place of each row along the direction of row 1, ties averaged."""
    rows = pool(spark, sf_dir)
    scored = scoring.seed_pairs(rows, [1]).select("seed_id", "id", F.round(vectors.dot(F.col("vector"), F.col("seed_vector")), 9).alias("score"))
    places = ranks.percentiles(scored, ["score"]).select("id", F.round("score", 9).alias("percentile"))
    return scored.select("id", "score").join(places, "id")


@query(f"""WITH {POOL}, s AS (SELECT p.id, round(list_dot_product(p.v, d.v), 2) AS s FROM pool p, pool d WHERE d.id = 1),
r AS (SELECT id, s AS score, round((rank() OVER (ORDER BY s) - 1 + (count(*) OVER (PARTITION BY s) - 1) / 2.0) / (count(*) OVER () - 1), 9)::DOUBLE AS percentile FROM s)
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY percentile DESC, id)::INT AS position FROM r) WHERE position BETWEEN 21 AND 60""")
def sensation_sort(spark, sf_dir):
    """A page of the pool sorted by the percentile along the direction of row 1, with many ties."""
    rows = pool(spark, sf_dir)
    scored = scoring.seed_pairs(rows, [1]).select("id", F.round(vectors.dot(F.col("vector"), F.col("seed_vector")), 2).alias("score"))
    return ranks.sorted_page(scored, "score", 20, 40).withColumn("percentile", F.round("percentile", 9))


def track_pairs(spark, sf_dir, seeds=SEEDS) -> DataFrame:
    rows = pool(spark, sf_dir).select("id", "vector").join(tracks(spark, sf_dir).select("id", F.col("genres").alias("tags"), "bpm", "year"), "id")
    return scoring.terms(scoring.seed_pairs(rows, seeds))


TERMS = f"""{POOL}, {TRACKS},
x AS (SELECT p.id, p.v, t.genres, t.bpm, t.year FROM pool p JOIN tracks t USING (id)),
terms AS (SELECT s.id AS seed_id, p.id, round(list_dot_product(p.v, s.v), 9) AS clap,
  round(len(list_intersect(p.genres, s.genres)) / len(list_distinct(list_concat(p.genres, s.genres))), 9) AS genre,
  round(-CASE WHEN p.bpm = 0 OR s.bpm = 0 THEN 0.5 ELSE abs(p.bpm - s.bpm) / 40.0::DOUBLE END, 9) AS bpm,
  round(-CASE WHEN p.year = 0 OR s.year = 0 THEN 0.5 ELSE abs(p.year - s.year) / 25.0::DOUBLE END, 9) AS era
  FROM x p JOIN x s ON s.id IN (0, 7, 42))"""


@query(f"WITH {TERMS} SELECT seed_id, id, round(clap + 0.3::DOUBLE * genre + 0.3::DOUBLE * bpm + 0.1::DOUBLE * era, 6) AS score FROM terms")
def score_raw(spark, sf_dir):
    return scoring.fused(track_pairs(spark, sf_dir), "raw").select("seed_id", "id", F.round("score", 6).alias("score"))


ZED = "({0} - avg({0}) OVER w) / stddev_pop({0}) OVER w"


@query(f"""WITH {TERMS} SELECT seed_id, id, round({ZED.format('clap')} + 0.3::DOUBLE * {ZED.format('genre')} + 0.3::DOUBLE * {ZED.format('bpm')} + 0.1::DOUBLE * {ZED.format('era')}, 7) AS score
FROM terms WINDOW w AS (PARTITION BY seed_id)""")
def score_z(spark, sf_dir):
    return scoring.fused(track_pairs(spark, sf_dir), "z").select("seed_id", "id", F.round("score", 7).alias("score"))


PCT = "((rank() OVER (PARTITION BY seed_id ORDER BY {0}) - 1 + (count(*) OVER (PARTITION BY seed_id, {0}) - 1) / 2) / (count(*) OVER (PARTITION BY seed_id) - 1))"


@query(f"WITH {TERMS} SELECT seed_id, id, round({PCT.format('clap')} + 0.3::DOUBLE * {PCT.format('genre')} + 0.3::DOUBLE * {PCT.format('bpm')} + 0.1::DOUBLE * {PCT.format('era')}, 8) AS score FROM terms")
def score_rank(spark, sf_dir):
    return scoring.fused(track_pairs(spark, sf_dir), "rank").select("seed_id", "id", F.round("score", 8).alias("score"))


@query(f"""WITH {TERMS} SELECT seed_id, id, term, round(value, 6) + 0.0::DOUBLE AS value FROM (
  SELECT seed_id, id, unnest(['clap', 'genre', 'bpm', 'era']) AS term, unnest([clap, 0.3::DOUBLE * genre, 0.3::DOUBLE * bpm, 0.1::DOUBLE * era]) AS value FROM terms)""")
def explain_terms(spark, sf_dir):
    """Each term's share of the score."""
    parts = scoring.fused(track_pairs(spark, sf_dir), "raw")
    named = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"c_{t}").alias("value")) for t in scoring.WEIGHTS])
    return parts.select("seed_id", "id", F.explode(named).alias("x")).select("seed_id", "id", "x.term", (F.round("x.value", 6) + F.lit(0.0)).alias("value"))


@query(f"""WITH {POOL}, m AS (SELECT artist, d, avg(x) AS m FROM (SELECT artist, unnest(range(64)) AS d, unnest(v) AS x FROM pool) GROUP BY artist, d),
c AS (SELECT artist, list(m ORDER BY d) AS c FROM m GROUP BY artist)
SELECT c.artist, round(list_dot_product(c.c, p.v) / sqrt(list_dot_product(c.c, c.c)), 6) AS affinity FROM c, pool p WHERE p.id = 0""")
def artist_profile(spark, sf_dir):
    rows = pool(spark, sf_dir)
    profiles = vectors.centroid(rows, "vector", ("artist",))
    seed = rows.where("id = 0").select(F.col("vector").alias("q"))
    return profiles.crossJoin(F.broadcast(seed)).select("artist", F.round(vectors.dot(vectors.unit(F.col("centroid")), F.col("q")), 6).alias("affinity"))


@query(f"""WITH {KNN}, t AS (SELECT n.id, n.rank, (a.artist = b.artist)::INT AS hit FROM near n JOIN pool a ON a.id = n.id JOIN pool b ON b.id = n.neighbour WHERE n.rank <= 10)
SELECT round(avg(p), 6) AS precision_at_10, round(avg(mrr), 6) AS mrr FROM (SELECT id, sum(hit) / 10.0::DOUBLE AS p, coalesce(max(hit / rank::DOUBLE), 0) AS mrr FROM t GROUP BY id)""")
def harness_precision_mrr(spark, sf_dir):
    """Precision at 10 and mean reciprocal rank of same-artist neighbours, over all rows as seeds."""
    rows = pool(spark, sf_dir).select("id", "artist")
    top = scoring.nearest(pool(spark, sf_dir), 10).join(rows, "id").join(rows.select(F.col("id").alias("neighbour"), F.col("artist").alias("other")), "neighbour")
    hit = F.when(F.col("artist") == F.col("other"), 1.0).otherwise(0.0)
    each = top.groupBy("id").agg((F.sum(hit) / 10).alias("p"), F.max(hit / F.col("rank")).alias("mrr"))
    return each.agg(F.round(F.avg("p"), 6).alias("precision_at_10"), F.round(F.avg("mrr"), 6).alias("mrr"))


@query(f"""WITH {KNN}, g AS (SELECT artist, count(*) AS n FROM pool GROUP BY artist HAVING count(*) >= 5),
t AS (SELECT a.id, least(25, g.n - 1) AS k, count(b.id) FILTER (WHERE n.rank <= 25 AND b.artist = a.artist) AS hits
  FROM near n JOIN pool a ON a.id = n.id JOIN pool b ON b.id = n.neighbour JOIN g ON g.artist = a.artist GROUP BY a.id, g.n)
SELECT round(avg(hits / k::DOUBLE), 6) AS recall, count(*) AS seeds FROM t""")
def recall_at_25(spark, sf_dir):
    """Recall of the seed's group among 25, at most as many as the group has."""
    rows = pool(spark, sf_dir).select("id", "artist")
    groups = rows.groupBy("artist").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    top = scoring.nearest(pool(spark, sf_dir), 25).join(rows, "id").join(rows.select(F.col("id").alias("neighbour"), F.col("artist").alias("other")), "neighbour")
    hits = top.groupBy("id", "artist").agg(F.count_if(F.col("artist") == F.col("other")).alias("hits")).join(groups, "artist")
    return hits.agg(F.round(F.avg(F.col("hits") / F.least(F.lit(25), F.col("n") - 1)), 6).alias("recall"), F.count(F.lit(1)).alias("seeds"))


@query(f"""WITH {ranked_sql()}, f AS (SELECT s.id AS seed_id, p.id, row_number() OVER (PARTITION BY s.id ORDER BY round({DISTANCE}, 9), p.id) AS rank FROM pool p JOIN pool s ON s.id IN (0, 7, 42) AND p.id <> s.id)
SELECT r.seed_id, round(corr(r.rank, f.rank), 6) AS spearman, count(*) FILTER (WHERE r.rank <= 25 AND f.rank <= 25) AS overlap FROM ranked r JOIN f USING (seed_id, id) GROUP BY r.seed_id""")
def overlap_spearman(spark, sf_dir):
    rows = pool(spark, sf_dir)
    near = lists.ranked(seed_scores(rows, SEEDS)).select("seed_id", "id", "rank")
    pairs = scoring.seed_pairs(rows, SEEDS).where("id <> seed_id")
    far = pairs.select("seed_id", "id", (-F.round(vectors.weighted_distance(F.col("vector"), F.col("seed_vector"), GROUP_WEIGHTS), 9)).alias("score"))
    both = near.join(lists.ranked(far).select("seed_id", "id", F.col("rank").alias("other")), ["seed_id", "id"])
    return both.groupBy("seed_id").agg(F.round(F.corr("rank", "other"), 6).alias("spearman"), F.count_if((F.col("rank") <= 25) & (F.col("other") <= 25)).alias("overlap"))


@query(f"""WITH {ranked_sql()}, t AS (SELECT r.seed_id, r.rank, r.id, p.v, lag(p.v) OVER (PARTITION BY r.seed_id ORDER BY r.rank) AS u FROM ranked r JOIN pool p USING (id) WHERE r.rank <= 30)
SELECT seed_id, rank::INT AS rank, id, round(list_dot_product(v, u), 6) AS step FROM t""")
def transitions(spark, sf_dir):
    rows = pool(spark, sf_dir)
    head = lists.ranked(seed_scores(rows, SEEDS), 30).join(rows.select("id", "vector"), "id")
    before = F.lag("vector").over(Window.partitionBy("seed_id").orderBy("rank"))
    return head.withColumn("u", before).select("seed_id", "rank", "id", F.round(vectors.dot(F.col("vector"), F.col("u")), 6).alias("step"))


@query(f"""WITH {ranked_sql()} SELECT seed_id, floor(score / 0.05)::BIGINT AS band, count(*) AS n FROM ranked GROUP BY 1, 2""")
def fit_bands(spark, sf_dir):
    return seed_scores(pool(spark, sf_dir), SEEDS).groupBy("seed_id", F.floor(F.col("score") / 0.05).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ranked_sql()} SELECT seed_id, t AS line, count(*) FILTER (WHERE score >= t) AS kept FROM ranked, (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS t) GROUP BY 1, 2""")
def kept_at_lines(spark, sf_dir):
    kept = [F.struct(F.lit(t).alias("line"), F.count_if(F.col("score") >= t).alias("kept")) for t in (0.1, 0.2, 0.3)]
    return seed_scores(pool(spark, sf_dir), SEEDS).groupBy("seed_id").agg(*[k.alias(f"k{i}") for i, k in enumerate(kept)]).select("seed_id", F.explode(F.array("k0", "k1", "k2")).alias("x")).select("seed_id", "x.*")


@query(f"""WITH {TRACKS}, z AS (SELECT id, (ln(seconds + 1) - avg(ln(seconds + 1)) OVER ()) / stddev_pop(ln(seconds + 1)) OVER () AS z FROM tracks)
SELECT id, round(z, 6) AS z, round(2 * (z - lo) / (hi - lo) - 1, 6) AS energy FROM z, (SELECT quantile_cont(z, 0.1) AS lo, quantile_cont(z, 0.9) AS hi FROM z)""")
def energy_axis(spark, sf_dir):
    """z-scores scaled so that the 10th and 90th percentiles are -1 and 1."""
    x = F.log(F.col("seconds") + 1)
    rows = tracks(spark, sf_dir).select("id", x.alias("x"))
    stats = rows.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.percentile("x", F.array(F.lit(0.1), F.lit(0.9))).alias("p"))
    z = rows.crossJoin(F.broadcast(stats)).select("id", ((F.col("x") - F.col("m")) / F.col("s")).alias("z"), *[((F.element_at("p", k) - F.col("m")) / F.col("s")).alias(n) for k, n in ((1, "lo"), (2, "hi"))])
    return z.select("id", F.round("z", 6).alias("z"), F.round(2 * (F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) - 1, 6).alias("energy"))


@query(f"WITH {TRACKS} SELECT round(regr_slope(bpm, 20 * log10(seconds)), 6) AS slope, round(regr_intercept(bpm, 20 * log10(seconds)), 6) AS intercept, count(*) AS pairs FROM tracks WHERE seconds > 0 AND bpm > 0")
def level_fit(spark, sf_dir):
    rows = tracks(spark, sf_dir).where("seconds > 0 AND bpm > 0").select("bpm", (20 * F.log10("seconds")).alias("db"))
    return rows.agg(F.round(F.regr_slope("bpm", "db"), 6).alias("slope"), F.round(F.regr_intercept("bpm", "db"), 6).alias("intercept"), F.count(F.lit(1)).alias("pairs"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, p_size % 24 AS k FROM lineitem JOIN part ON p_partkey = l_partkey),
w AS (SELECT lag(k) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, k) AS a, k AS b FROM l),
p AS (SELECT a, b, count(*) AS n, a // 2 AS ta, b // 2 AS tb, a % 2 = 0 AS ma, b % 2 = 0 AS mb FROM w WHERE a IS NOT NULL GROUP BY a, b)
SELECT a::BIGINT AS a, b::BIGINT AS b, n, CASE WHEN ma = mb THEN CASE (tb - ta + 12) % 12 WHEN 0 THEN 1.0 WHEN 5 THEN 0.8 WHEN 7 THEN 0.8 WHEN 2 THEN 0.4 WHEN 10 THEN 0.4 ELSE 0.0 END
  WHEN ((CASE WHEN ma THEN tb ELSE ta END) + 3) % 12 = (CASE WHEN ma THEN ta ELSE tb END) THEN 0.8 ELSE 0.0 END::DOUBLE AS compatibility FROM p""")
def key_table(spark, sf_dir):
    """The keys of neighbours in every list, how often they meet and how well they go together."""
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 24).cast("long").alias("b"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(keys, "l_partkey")
    met = items.withColumn("a", F.lag("b").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "b"))).where("a IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    half = lambda c: F.floor(F.col(c) / 2)
    fit = text.key_compatibility(half("a"), F.col("a") % 2 == 0, half("b"), F.col("b") % 2 == 0)
    return met.select("a", "b", "n", fit.alias("compatibility"))


@query(f"""WITH {ranked_sql()}, {TRACKS}, m AS (SELECT r.seed_id, r.rank, t.*, lag(t.bpm) OVER (PARTITION BY r.seed_id ORDER BY r.rank) AS before FROM ranked r JOIN tracks t USING (id) WHERE r.rank <= 30)
SELECT seed_id, round(count(DISTINCT artist) / count(*)::DOUBLE, 6) AS artist_ratio, round(avg(abs(bpm - before)), 6) AS bpm_step, max(year) - min(year) AS years, count(DISTINCT year // 10) AS decades FROM m GROUP BY seed_id""".replace("t.*", "t.artist, t.bpm, t.year"))
def mix_descriptors(spark, sf_dir):
    head = lists.ranked(seed_scores(pool(spark, sf_dir), SEEDS), 30).select("seed_id", "rank", "id").join(tracks(spark, sf_dir), "id")
    step = F.abs(F.col("bpm") - F.lag("bpm").over(Window.partitionBy("seed_id").orderBy("rank")))
    return head.withColumn("step", step).groupBy("seed_id").agg(
        F.round(F.countDistinct("artist") / F.count(F.lit(1)), 6).alias("artist_ratio"), F.round(F.avg("step"), 6).alias("bpm_step"),
        (F.max("year") - F.min("year")).alias("years"), F.countDistinct(text.decade(F.col("year"))).alias("decades"),
    )


@query("""WITH e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b, 1.0 / (1 + abs(c_nationkey - s_nationkey)) AS score FROM customer JOIN supplier ON c_nationkey <> s_nationkey AND (c_nationkey + s_nationkey) % 7 = 0),
u AS (SELECT a, b, score FROM e UNION ALL SELECT b, a, score FROM e), seeds AS (SELECT unnest([1, 5, 9]) AS a)
SELECT n_nationkey AS artist, round(max(CASE WHEN n_nationkey = seeds.a THEN 1.0 ELSE coalesce(u.score, 0) END), 6)::DOUBLE AS affinity
FROM nation CROSS JOIN seeds LEFT JOIN u ON u.a = seeds.a AND u.b = n_nationkey GROUP BY 1""")
def artist_affinity(spark, sf_dir):
    """The strongest edge from any seed artist to each artist; a seed has 1."""
    nations = [table(spark, sf_dir, t).select(F.col(c).alias(n)).distinct() for t, c, n in (("customer", "c_nationkey", "a"), ("supplier", "s_nationkey", "b"))]
    edges = nations[0].join(nations[1], (F.col("a") != F.col("b")) & ((F.col("a") + F.col("b")) % 7 == 0)).select("a", "b", (1.0 / (1 + F.abs(F.col("a") - F.col("b")))).alias("score"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).where(F.col("a").isin(1, 5, 9))
    reached = both.groupBy(F.col("b").alias("artist")).agg(F.max("score").alias("score"))
    seed = F.col("artist").isin(1, 5, 9)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("artist")).join(reached, "artist", "left").select("artist", F.round(F.when(seed, 1.0).otherwise(F.coalesce("score", F.lit(0.0))), 6).alias("affinity"))


KEY = "-ln(('0x' || substr(md5('draw:' || draw || ':' || seed_id || ':' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE + power(2.0::DOUBLE, -33)) / exp(-(rank - 1) / (3.0::DOUBLE + 30.0::DOUBLE * v))"


@query(f"""WITH RECURSIVE {ranked_sql(score=f'-round({DISTANCE}, 9)')},
asks AS (SELECT *, variety / 9.0::DOUBLE AS v, variety + 10 AS draw FROM (SELECT unnest([0, 4, 9]) AS variety)),
wide AS (SELECT r.*, a.variety, a.draw, a.v FROM ranked r, asks a WHERE a.v = 0 OR r.rank <= 12 * (1 + round_even(a.v * 7, 0))),
keyed AS (SELECT *, row_number() OVER (PARTITION BY seed_id, variety ORDER BY CASE WHEN v = 0 THEN rank ELSE {KEY} END, id) AS place, count(*) OVER (PARTITION BY seed_id, variety) AS n FROM wide),
walk AS (
  SELECT DISTINCT seed_id, variety, 0::BIGINT AS r, []::BIGINT[] AS ids, []::VARCHAR[] AS arts FROM keyed
  UNION ALL
  SELECT w.seed_id, w.variety, w.r + 1, CASE WHEN ok THEN list_append(ids, x.id) ELSE ids END, CASE WHEN ok THEN list_append(arts, x.artist) ELSE arts END
  FROM walk w JOIN keyed x ON x.seed_id = w.seed_id AND x.variety = w.variety AND x.place = w.r + 1,
    LATERAL (SELECT NOT (x.artist <> '' AND list_contains(arts[greatest(len(arts) - 2, 1):], x.artist)) OR x.v > 0 AND x.n - x.place + len(ids) <= 12 AS ok) o WHERE len(ids) < 12),
last AS (SELECT seed_id, variety, arg_max(ids, r) AS ids FROM walk GROUP BY seed_id, variety),
listed AS (SELECT seed_id, variety, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS position FROM last)
SELECT l.seed_id, l.variety, l.position::INT AS position, l.id, r.rank::INT AS rank FROM listed l JOIN ranked r USING (seed_id, id)""")
def baseline_mixes(spark, sf_dir):
    """The baseline engine's mixes of three seeds without, with some and with most variety."""
    pairs = scoring.seed_pairs(pool(spark, sf_dir), SEEDS).where("id <> seed_id")
    far = pairs.select("seed_id", "id", "artist", (-F.round(vectors.weighted_distance(F.col("vector"), F.col("seed_vector"), GROUP_WEIGHTS), 9)).alias("score"))
    asks = F.explode(F.array(*[F.struct(F.lit(v).alias("variety"), F.lit(v + 10).alias("draw")) for v in (0, 4, 9)]))
    ranking = lists.ranked(far).withColumn("ask", asks).select("*", "ask.*").drop("ask")
    return lists.sampled_mix(ranking, 12, 3).select("seed_id", "variety", "position", "id", "rank")
