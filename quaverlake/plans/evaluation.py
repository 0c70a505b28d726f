"""Queries on what rankings and lists are worth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import contrastive, evaluation, lists, scoring, states
from .catalog import MARKS, NORMAL, used
from .registry import POOL, TRACKS, pool, query, table, tracks
from .similarity import SEEDS, TERMS, ranked_sql, seed_scores, track_pairs

PARTS = {"clap": "clap", "genre": "0.3::DOUBLE * genre", "bpm": "0.3::DOUBLE * bpm", "era": "0.1::DOUBLE * era"}


def _top(left_out: str = "") -> str:
    score = " + ".join(v for k, v in PARTS.items() if k != left_out)
    return f"SELECT seed_id, id FROM (SELECT seed_id, id, row_number() OVER (PARTITION BY seed_id ORDER BY round({score}, 9) DESC, id) AS rank FROM terms WHERE id <> seed_id) WHERE rank <= 25"


@query(f"WITH {TERMS}, base AS ({_top()}) " + " UNION ALL ".join(f"SELECT seed_id, '{t}' AS term, count(*) FILTER (WHERE base.id IS NULL) AS changed FROM ({_top(t)}) x LEFT JOIN base USING (seed_id, id) GROUP BY seed_id" for t in PARTS))
def term_influence(spark, sf_dir):
    """How many of 25 change when a term is left out."""
    return evaluation.influence(track_pairs(spark, sf_dir), scoring.WEIGHTS, 25)


@query(f"""WITH {TERMS}, m AS (SELECT seed_id, {', '.join(f'avg(abs({v})) AS m_{k}' for k, v in PARTS.items())} FROM terms WHERE id <> seed_id GROUP BY seed_id)
""" + " UNION ALL ".join(f"SELECT seed_id, '{k}' AS term, round(m_{k} / (m_clap + m_genre + m_bpm + m_era), 6) AS share FROM m" for k in PARTS))
def term_say(spark, sf_dir):
    parts = scoring.fused(track_pairs(spark, sf_dir).where("id <> seed_id"), "raw")
    return evaluation.say(parts, list(scoring.WEIGHTS)).withColumn("share", F.round("share", 6))


@query(f"""WITH {ranked_sql()}, o AS (SELECT seed_id, id, rank FROM ranked WHERE rank <= 30 AND id % 2 = 0) SELECT r.seed_id, r.id, coalesce(o.rank, 31)::INT AS rank FROM ranked r LEFT JOIN o USING (seed_id, id) WHERE r.rank <= 60""")
def external_ranks(spark, sf_dir):
    ranking = lists.ranked(seed_scores(pool(spark, sf_dir), SEEDS), 60)
    return evaluation.list_ranks(ranking.select("seed_id", "id"), ranking.where("rank <= 30 AND id % 2 = 0"), 30)


@query(f"WITH {TRACKS}, {MARKS} SELECT count(*) FILTER (WHERE loved = 1) AS loved, count(*) FILTER (WHERE rating >= 4) AS rated, count(*) FILTER (WHERE plays >= 1) AS played, count(*) FILTER (WHERE skips >= 2) AS skipped, count(*) FILTER (WHERE loved = 1 OR rating >= 4 OR plays >= 1 OR skips >= 2) AS any_signal, count(*) AS rows FROM used")
def signal_counts(spark, sf_dir):
    return evaluation.signals(used(spark, sf_dir))


@query(f"WITH {TRACKS}, {MARKS}, n AS (SELECT count(*) AS n FROM used WHERE rating >= 4) SELECT (n * (n - 1) // 2)::BIGINT AS pairs FROM n")
def rated_clique(spark, sf_dir):
    return evaluation.clique_pairs(used(spark, sf_dir).withColumn("rated", F.col("rating") >= 4), "rated")


@query(f"WITH {TRACKS} SELECT family AS genre, arg_min(id, row(title, id)) AS id FROM tracks GROUP BY 1")
def first_seed_of_genre(spark, sf_dir):
    return evaluation.first_of_genre(tracks(spark, sf_dir).withColumn("genre", F.col("family")), "genre", "title")


@query(f"WITH {TRACKS} SELECT s.id AS seed_id, p.id FROM tracks p JOIN tracks s ON s.id IN (0, 7, 42) AND len(list_intersect(p.genres, s.genres)) = 0")
def cross_genre_negatives(spark, sf_dir):
    rows = tracks(spark, sf_dir).select("id", F.col("genres").alias("tags"))
    return evaluation.other_genre(rows.where(F.col("id").isin(SEEDS)), rows)


@query(f"WITH {ranked_sql([0])}, {TRACKS} SELECT count(*) FILTER (WHERE regexp_matches(lower(t.title), 'red|blue')) AS hits, count(*) AS n FROM ranked r JOIN tracks t USING (id) WHERE rank <= 50")
def keyword_hit_rate(spark, sf_dir):
    found = lists.ranked(seed_scores(pool(spark, sf_dir), [0]), 50).select("id").join(tracks(spark, sf_dir).select("id", "title"), "id")
    return evaluation.keyword_hits(found, "title", ["red", "blue"])


@query(f"WITH {POOL} SELECT s.id AS seed_id, p.id, round((abs(p.v[1] - s.v[1]) + abs(p.v[2] - s.v[2]) + abs(p.v[3] - s.v[3])) / 3, 6) AS gap FROM pool p JOIN pool s ON s.id IN (0, 7, 42)")
def sensation_gaps(spark, sf_dir):
    rows = pool(spark, sf_dir).select("id", *[F.element_at("vector", k).alias(f"axis{k}") for k in (1, 2, 3)])
    return evaluation.sensation_gap(scoring.seed_pairs(rows, SEEDS), ["axis1", "axis2", "axis3"]).withColumn("gap", F.round("gap", 6))


@query(f"WITH {POOL}, g AS (SELECT 'seeds' AS grp, unnest([0, 7]) AS k UNION ALL SELECT 'liked', unnest([3, 4]) UNION ALL SELECT 'disliked', 5) SELECT grp AS \"to\", p.id, round(avg(list_dot_product(p.v, s.v)), 6) AS closeness FROM pool p, g JOIN pool s ON s.id = g.k GROUP BY 1, 2")
def closeness_lists(spark, sf_dir):
    return evaluation.closeness(pool(spark, sf_dir), {"seeds": [0, 7], "liked": [3, 4], "disliked": [5]}).withColumn("closeness", F.round("closeness", 6))


@query(f"WITH {ranked_sql()} SELECT seed_id, id, rank::INT AS rank, CASE WHEN id % 3 = 0 THEN 'outside' WHEN score < 0.1 THEN 'below-line' WHEN rank > 40 THEN 'never-reached' ELSE 'reached' END AS why FROM ranked")
def absence_reasons(spark, sf_dir):
    ranking = lists.ranked(seed_scores(pool(spark, sf_dir), SEEDS))
    return evaluation.placed(ranking, 40, 0.1, pool(spark, sf_dir).where("id % 3 <> 0"))


@query(f"WITH {ranked_sql()} SELECT seed_id, id, rank::INT AS rank FROM ranked WHERE rank BETWEEN 26 AND 35")
def next_candidates(spark, sf_dir):
    return evaluation.next_after(lists.ranked(seed_scores(pool(spark, sf_dir), SEEDS), 35), 25).select("seed_id", "id", "rank")


@query(f"WITH {ranked_sql()} SELECT DISTINCT id FROM ranked WHERE rank <= 20")
def validation_union(spark, sf_dir):
    return evaluation.top_union(lists.ranked(seed_scores(pool(spark, sf_dir), SEEDS), 20), 20)


@query(f"""WITH {TRACKS}, s AS (SELECT * FROM tracks WHERE id IN (0, 7, 42)) SELECT DISTINCT s.id AS seed_id, t.id FROM tracks t JOIN s ON t.id <> s.id AND (t.artist = s.artist OR t.album = s.album OR t.title = s.title)""")
def relevance_union(spark, sf_dir):
    """Rows of the seed's artist, album or title."""
    return evaluation.relevant(tracks(spark, sf_dir).withColumn("is_seed", F.col("id").isin(SEEDS)), ["artist", "album", "title"])


@query(f"""WITH c AS (SELECT item_id AS id, {NORMAL.format('text')} AS strict, replace({NORMAL.format('text')}, ' ', '') AS loose FROM benchmark),
t AS (SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN strict WHEN item_id % 3 = 1 THEN replace(strict, ' ', '') ELSE strict || 'x' END AS strict, CASE WHEN item_id % 3 < 2 THEN loose ELSE loose || 'x' END AS loose FROM (SELECT id AS item_id, strict, loose FROM c)),
s AS (SELECT strict, min(id) AS s_id FROM c WHERE strict <> '' GROUP BY 1), l AS (SELECT loose, min(id) AS l_id FROM c WHERE loose <> '' GROUP BY 1)
SELECT t.id, coalesce(s_id, l_id) AS match_id, CASE WHEN s_id IS NOT NULL THEN 'strict' WHEN l_id IS NOT NULL THEN 'loose' WHEN t.loose = '' THEN 'empty' ELSE 'miss' END AS kind FROM t LEFT JOIN s USING (strict) LEFT JOIN l USING (loose)""")
def two_tier_resolve(spark, sf_dir):
    """Names by their normal form, else without spaces."""
    names = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), text.match_key(F.col("text")).alias("strict"), text.loose_key(F.col("text")).alias("loose"))
    k = F.col("id") % 3
    asked = names.select("id", F.when(k == 0, F.col("strict")).when(k == 1, F.replace("strict", F.lit(" "), F.lit(""))).otherwise(F.concat("strict", F.lit("x"))).alias("strict"), F.when(k < 2, F.col("loose")).otherwise(F.concat("loose", F.lit("x"))).alias("loose"))
    return evaluation.resolved(asked, names)


@query(f"WITH {TRACKS}, u AS (SELECT title, min(id) AS match_id FROM tracks GROUP BY 1 HAVING count(*) = 1) SELECT id, match_id FROM tracks LEFT JOIN u USING (title)")
def unique_name_match(spark, sf_dir):
    rows = tracks(spark, sf_dir).select("id", "title")
    return evaluation.by_unique_name(rows, rows, "title").select("id", "match_id")


@query(f"""WITH p AS (SELECT *, split_part(replace(url, 'https://', ''), '/', 1) AS host FROM pages) SELECT page_id AS id FROM p WHERE contains(lower(url), 'm.')""")
def path_search(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.contains(F.lower("url"), F.lit("m."))).select(F.col("page_id").alias("id"))


@query(f"WITH {TRACKS} SELECT title, min(pool_i) AS id FROM tracks WHERE contains(lower(title), 're') GROUP BY title ORDER BY id LIMIT 50")
def search_distinct(spark, sf_dir):
    """A search with one row a title, the first in pool order."""
    return tracks(spark, sf_dir).where(F.contains(F.lower("title"), F.lit("re"))).groupBy("title").agg(F.min("pool_i").alias("id")).orderBy("id").limit(50)


@query(f"WITH {POOL}, x AS (SELECT p.id, avg(list_dot_product(p.v, s.v)) AS a FROM pool p, pool s WHERE s.id IN (1, 2) GROUP BY 1), y AS (SELECT p.id, avg(list_dot_product(p.v, s.v)) AS b FROM pool p, pool s WHERE s.id IN (5, 6) GROUP BY 1) SELECT id, round(a - b, 6) AS score FROM x JOIN y USING (id)")
def direction_scores(spark, sf_dir):
    """Place along the direction from the mean of some rows to that of others."""
    rows = pool(spark, sf_dir)
    up, down = (vectors.centroid(rows.where(F.col("id").isin(ids)), "vector").select(F.col("centroid").alias(n)) for ids, n in (([1, 2], "up"), ([5, 6], "down")))
    both = rows.crossJoin(F.broadcast(up)).crossJoin(F.broadcast(down))
    return both.select("id", F.round(vectors.dot(F.col("vector"), vectors.less(F.col("up"), F.col("down"))), 6).alias("score"))


@query(f"""WITH {POOL}, lists AS (SELECT id // 15 AS list_id, id, v FROM pool),
tight AS (SELECT a.list_id, count(DISTINCT a.id) AS n, avg(list_dot_product(a.v, b.v)) AS mean FROM lists a JOIN lists b ON a.list_id = b.list_id AND a.id <> b.id GROUP BY 1 HAVING count(DISTINCT a.id) >= 12),
tried AS (SELECT n AS size, draw, k, floor(('0x' || substr(md5('null:' || n || ':' || draw || ':' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (SELECT count(*) FROM pool))::BIGINT AS id
  FROM (SELECT DISTINCT n FROM tight), range(1, 61) d(draw), LATERAL (SELECT unnest(range(1, n * 4 + 1)) AS k)),
drawn AS (SELECT size, draw, id FROM (SELECT size, draw, id, row_number() OVER (PARTITION BY size, draw ORDER BY min(k)) AS place FROM tried GROUP BY 1, 2, 3) WHERE place <= size),
x AS (SELECT size, draw, p.id, v FROM drawn JOIN pool p USING (id)),
chance AS (SELECT size, avg(m) AS expected, stddev_pop(m) AS spread FROM (SELECT a.size, a.draw, avg(list_dot_product(a.v, b.v)) AS m FROM x a JOIN x b ON a.size = b.size AND a.draw = b.draw AND a.id <> b.id GROUP BY 1, 2) GROUP BY 1)
SELECT list_id, n, round(mean, 6) AS mean, round(mean - expected, 6) AS excess, round((mean - expected) / spread, 6) AS z FROM tight JOIN chance ON size = n""")
def coherence(spark, sf_dir):
    """Runs of fifteen rows as lists, against lists by chance."""
    rows = pool(spark, sf_dir).select("id", "vector")
    found = evaluation.coherence(rows.select(F.floor(F.col("id") / 15).alias("list_id"), "id"), rows)
    return found.select("list_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "excess", "z")])


@query(f"""WITH {POOL}, m AS (SELECT artist, d, avg(x) AS m FROM (SELECT artist, unnest(range(64)) AS d, unnest(v) AS x FROM pool) GROUP BY artist, d),
c AS (SELECT artist, list(m ORDER BY d) AS c FROM m GROUP BY artist), a AS (SELECT p.*, list_transform(c.c, lambda x: x / sqrt(list_dot_product(c.c, c.c))) AS c FROM pool p JOIN c USING (artist)),
t AS (SELECT s.id AS seed_id, p.id, list_dot_product(p.v, s.v) AS x, list_dot_product(p.c, s.c) AS y FROM a p JOIN a s ON s.id IN (0, 7, 42)),
z AS (SELECT seed_id, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM t GROUP BY 1)
SELECT seed_id, id, round((x - mx) / sx + 0.5 * (y - my) / sy, 6) AS score FROM t JOIN z USING (seed_id)""")
def profile_blend(spark, sf_dir):
    """Closeness and half of the closeness of the artists' profiles, each standardised."""
    rows = pool(spark, sf_dir)
    profiles = vectors.centroid(rows, "vector", ("artist",)).select("artist", vectors.unit(F.col("centroid")).alias("profile"))
    pairs = scoring.seed_pairs(rows.join(profiles, "artist"), SEEDS)
    close = pairs.select("seed_id", "id", vectors.dot(F.col("vector"), F.col("seed_vector")).alias("clap"), vectors.dot(F.col("profile"), F.col("seed_profile")).alias("profile"))
    return scoring.fused(close, "z", {"clap": 1.0, "profile": 0.5}).select("seed_id", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {TRACKS}, c AS (SELECT id, count(*) OVER (PARTITION BY title) > 1 OR id % 5 = 0 AS twin, md5('0:' || id) AS h FROM tracks),
t AS (SELECT id, twin FROM c WHERE twin ORDER BY h, id LIMIT 20), r AS (SELECT id, twin, row_number() OVER (ORDER BY h, id) AS place FROM c WHERE NOT twin)
SELECT id, twin FROM t UNION ALL SELECT id, twin FROM r WHERE place <= 60 - (SELECT count(*) FROM t)""")
def sampled_seeds(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    often = rows.groupBy("title").agg((F.count(F.lit(1)) > 1).alias("often"))
    return evaluation.sampled_seeds(rows.join(often, "title").select("id", (F.col("often") | (F.col("id") % 5 == 0)).alias("twin")), 60)


SWEEP = {name: (metric, [a] * 40 + [b] * 23 + [c]) for name, metric, a, b, c in (("plain", "euclidean", 1.0, 1.0, 1.0), ("plain cosine", "cosine", 1.0, 1.0, 1.0), ("timbre", "euclidean", 2.5, 0.6, 0.4), ("timbre cosine", "cosine", 2.5, 0.6, 0.4), ("rhythm", "euclidean", 0.5, 2.0, 1.0))}
CLOSE = {
    "euclidean": "-sqrt(list_sum(list_transform(range(1, 65), lambda i: power((p.v[i] - s.v[i]) * w[i], 2))))",
    "cosine": "list_cosine_similarity(list_transform(range(1, 65), lambda i: p.v[i] * w[i]), list_transform(range(1, 65), lambda i: s.v[i] * w[i]))",
}


@query(f"WITH {POOL}, each AS (" + " UNION ALL ".join(f"SELECT '{name}' AS config, s.id AS seed_id, p.id, round({CLOSE[m]}, 9) AS score FROM pool p JOIN pool s ON s.id IN (0, 7, 42) AND p.id <> s.id, (SELECT {w}::DOUBLE[] AS w)" for name, (m, w) in SWEEP.items()) + """),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, seed_id ORDER BY score DESC, id) AS rank FROM each) WHERE rank <= 20)
SELECT a.config, round(count(b.id) / 60.0::DOUBLE, 6) AS overlap FROM top a LEFT JOIN top b ON b.config = 'plain cosine' AND b.seed_id = a.seed_id AND b.id = a.id GROUP BY 1""")
def weight_sweep(spark, sf_dir):
    """The share of twenty nearest that each metric and weighting has in common with the plain cosine."""
    top = evaluation.swept(scoring.seed_pairs(pool(spark, sf_dir), SEEDS).where("id <> seed_id"), SWEEP, 20)
    plain = top.where("config = 'plain cosine'").select("seed_id", "id", F.lit(1).alias("hit"))
    return top.join(F.broadcast(plain), ["seed_id", "id"], "left").groupBy("config").agg(F.round(F.count("hit") / F.lit(60.0), 6).alias("overlap"))


@query(f"""WITH {TRACKS}, c AS (SELECT id, trim(artist) AS artist, trim(album) AS album, regexp_matches(lower(album), 'singles & loose tracks|loose tracks|b-sides|b sides|bootleg|unknown album|various artists|compilation') AS vague FROM tracks),
al AS (SELECT artist, album FROM c WHERE NOT vague GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 25),
f AS (SELECT c.* FROM c JOIN al USING (artist, album)),
s AS (SELECT artist, count(*) AS n FROM c GROUP BY 1 HAVING count(*) > 1),
d AS (SELECT c.artist, c.id, ('0x' || substr(md5('ring:' || id), 1, 8))::BIGINT % (CASE WHEN n <= 21 THEN 1 ELSE ceil(n / 1000.0) END)::BIGINT AS ring FROM c JOIN s USING (artist)),
p AS (SELECT *, row_number() OVER (PARTITION BY artist, ring ORDER BY md5(id::VARCHAR), id) AS place, count(*) OVER (PARTITION BY artist, ring) AS m FROM d)
SELECT 'album' AS kind, a.id, b.id AS mate FROM f a JOIN f b ON a.artist = b.artist AND a.album = b.album AND a.id <> b.id
UNION ALL SELECT 'artist', p.id, q.id FROM p, LATERAL (SELECT unnest(range(1, least(20, p.m - 1) + 1)) AS step) k JOIN p q ON q.artist = p.artist AND q.ring = p.ring AND q.place = (p.place - 1 + step) % p.m + 1""")
def label_bootstrap(spark, sf_dir):
    """Mates by album and by artist, a bounded number a row."""
    rows = tracks(spark, sf_dir).select("id", "artist", "album")
    return evaluation.label_pairs(rows, states.is_placeholder(F.col("album")))


@query()
def contrastive_heads(spark, sf_dir):
    """Recall of held-out lists, four of each label, by plain vectors, trained heads and their nulls."""
    rows = pool(spark, sf_dir)
    return contrastive.head_report(rows.select("id", "vector"), rows.select(F.concat_ws(":", "artist", (F.col("id") % 4).cast("string")).alias("list"), "id"))
