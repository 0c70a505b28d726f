"""What rankings and lists are worth: influence of terms, ranks of other lists, signals, coverage of genres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from . import lists, scoring


def top_of(table: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """``seed_id`` and ``id`` of each seed's best ``k`` by weighted terms."""
    total = sum((F.lit(w) * F.col(t) for t, w in weights.items() if w), F.lit(0.0))
    return lists.ranked(table.where("id <> seed_id").select("seed_id", "id", F.round(total, 9).alias("score")), k).select("seed_id", "id")


def influence(table: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """Of each seed's best ``k``, how many change when a term is left out."""
    base, out = top_of(table, weights, k).withColumn("was", F.lit(True)), None
    for term in (t for t, w in weights.items() if w):
        without = top_of(table, weights | {term: 0.0}, k)
        changed = without.join(base, ["seed_id", "id"], "left").groupBy("seed_id").agg(F.count_if(F.col("was").isNull()).alias("changed"))
        part = changed.select("seed_id", F.lit(term).alias("term"), "changed")
        out = part if out is None else out.unionByName(part)
    return out


def say(contributions: DataFrame, terms: list[str]) -> DataFrame:
    """Each term's share of what moved the scores of a list: mean size of its contribution, over the sum of all."""
    means = contributions.groupBy("seed_id").agg(*[F.avg(F.abs(F.col(f"c_{t}"))).alias(t) for t in terms])
    total = sum((F.col(t) for t in terms), F.lit(0.0))
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.when(total > 0, F.col(t) / total).otherwise(0.0).alias("share")) for t in terms])
    return means.select("seed_id", F.explode(pairs).alias("x")).select("seed_id", "x.*")


def list_ranks(wanted: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """Rank of each wanted (``seed_id``, ``id``) in another list; absent ones tie at ``k + 1``."""
    return wanted.join(other.select("seed_id", "id", "rank"), ["seed_id", "id"], "left").select("seed_id", "id", F.coalesce("rank", F.lit(k + 1)).alias("rank"))


def signals(used: DataFrame) -> DataFrame:
    """How many rows bear each mark of a user's taste, and any."""
    marks = {"loved": F.col("loved") == 1, "rated": F.col("rating") >= 4, "played": F.col("plays") >= 1, "skipped": F.col("skips") >= 2}
    some = F.lit(False)
    for m in marks.values():
        some = some | m
    return used.agg(*[F.count_if(m).alias(n) for n, m in marks.items()], F.count_if(some).alias("any_signal"), F.count(F.lit(1)).alias("rows"))


def first_of_genre(df: DataFrame, genre: str, order: str) -> DataFrame:
    """The first row of each genre."""
    return df.groupBy(genre).agg(F.min_by("id", F.struct(order, "id")).alias("id"))


def other_genre(seeds: DataFrame, pool: DataFrame) -> DataFrame:
    """Strong negatives of each seed: rows with tags, none of them the seed's.  Both have ``id`` and ``tags``."""
    chosen = seeds.where(F.size("tags") > 0).select(F.col("id").alias("seed_id"), F.col("tags").alias("seed_tags"))
    return pool.where(F.size("tags") > 0).join(F.broadcast(chosen), ~F.arrays_overlap("tags", "seed_tags")).select("seed_id", "id")


def keyword_hits(found: DataFrame, text: str, words: list[str]) -> DataFrame:
    """The share of results whose text has one of the words."""
    hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), w))
    return found.agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"))


def sensation_gap(pairs: DataFrame, axes: list[str]) -> DataFrame:
    """Mean difference of two rows over several scores."""
    gap = sum((F.abs(F.col(a) - F.col(f"seed_{a}")) for a in axes), F.lit(0.0)) / len(axes)
    return pairs.select("seed_id", "id", gap.alias("gap"))


def closeness(rows: DataFrame, groups: dict[str, list[int]]) -> DataFrame:
    """Mean cosine of each row with the members of each stated group (a few rows of a request)."""
    out = None
    for name, ids in groups.items():
        pairs = scoring.seed_pairs(rows, ids)
        mean = pairs.groupBy("id").agg(F.avg(vectors.dot(F.col("vector"), F.col("seed_vector"))).alias("closeness")).select(F.lit(name).alias("to"), "id", "closeness")
        out = mean if out is None else out.unionByName(mean)
    return out


def placed(ranking: DataFrame, last: int, line: float, mixable: DataFrame) -> DataFrame:
    """Why a candidate is not in a list: outside the collection, below the line, never reached, or reached."""
    inside = ranking.join(mixable.select("id").withColumn("inside", F.lit(True)), "id", "left")
    why = F.when(F.col("inside").isNull(), "outside").when(F.col("score") < line, "below-line").when(F.col("rank") > last, "never-reached").otherwise("reached")
    return inside.select("seed_id", "id", "rank", why.alias("why"))


def next_after(ranking: DataFrame, last: int, most: int = 10) -> DataFrame:
    """The candidates that follow where a walk stopped."""
    return ranking.where(F.col("rank").between(last + 1, last + most))


def resolved(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """``id`` of ``texts`` with its match by the strict key, else by the loose one, and the kind of the match.

    Both have ``id``, ``strict`` and ``loose``; of several matches the least id counts.
    """
    strict = catalog.where("strict <> ''").groupBy("strict").agg(F.min("id").alias("s_id"))
    loose = catalog.where("loose <> ''").groupBy("loose").agg(F.min("id").alias("l_id"))
    both = texts.join(strict, "strict", "left").join(loose, "loose", "left")
    kind = F.when(F.col("s_id").isNotNull(), "strict").when(F.col("l_id").isNotNull(), "loose").when(F.col("loose") == "", "empty").otherwise("miss")
    return both.select("id", F.coalesce("s_id", "l_id").alias("match_id"), kind.alias("kind"))


def by_unique_name(wanted: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
    """Matches by a name that one row of the catalog has alone."""
    alone = catalog.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("match_id")).where("n = 1").drop("n")
    return wanted.join(alone, name, "left")


def top_union(ranking: DataFrame, n: int) -> DataFrame:
    """Distinct ids of the best ``n`` of every list."""
    return ranking.where(F.col("rank") <= n).select("id").distinct()


def relevant(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows that share any of the keys with a seed: (``seed_id``, ``id``), distinct.  ``df`` has ``id``, ``is_seed`` and the keys."""
    out = None
    for key in keys:
        seeds = df.where("is_seed").select(F.col("id").alias("seed_id"), key)
        pairs = df.join(seeds, key).where("id <> seed_id").select("seed_id", "id")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def clique_pairs(marked: DataFrame, mark: str) -> DataFrame:
    """Number of pairs among the rows that bear a mark: it follows from their number."""
    n = F.count_if(F.col(mark))
    return marked.agg((n * (n - 1) / 2).cast("long").alias("pairs"))


def mean_pairs(members: DataFrame, keys: list[str]) -> DataFrame:
    """``n`` and ``mean``, the mean product of two different ``vector``s, of each group: from sums, no pairs are made."""
    square = vectors.dot(F.col("vector"), F.col("vector"))
    sums = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("own"))
    centre = F.col("centroid")
    met = sums.where("n > 1").join(vectors.centroid(members, "vector", tuple(keys)), keys)
    return met.select(*keys, "n", ((F.col("n") * F.col("n") * vectors.dot(centre, centre) - F.col("own")) / (F.col("n") * (F.col("n") - 1))).alias("mean"))


def coherence(listed: DataFrame, rows: DataFrame, draws: int = 60, least: int = 12) -> DataFrame:
    """How much tighter than chance each list is: ``z`` of its mean product against ``draws`` random ones of its size.

    ``listed`` has ``list_id`` and ``id``; ``rows`` has ids from 0 up without holes, and ``vector``.
    A draw takes the first different ids of four times as many tries, which leaves it
    some short where the list holds most rows.
    """
    tight = mean_pairs(listed.distinct().join(rows, "id"), ["list_id"]).where(F.col("n") >= least)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    cases = tight.select(F.col("n").alias("size")).distinct().crossJoin(F.broadcast(total)).select("size", "total", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    tried = F.transform(F.sequence(F.lit(1), F.col("size") * 4), lambda k: F.floor(text.hash_unit(F.lit("null"), F.col("size"), F.col("draw"), k) * F.col("total")))
    drawn = cases.select("size", "draw", F.explode(F.slice(F.array_distinct(tried), 1, F.col("size").cast("int"))).alias("id"))
    chance = mean_pairs(drawn.join(rows, "id"), ["size", "draw"]).groupBy("size").agg(F.avg("mean").alias("expected"), F.stddev_pop("mean").alias("spread"))
    spread = F.when(F.col("spread") > 0, F.col("spread")).otherwise(1e-9)
    return tight.join(F.broadcast(chance), F.col("n") == F.col("size")).select("list_id", "n", "mean", (F.col("mean") - F.col("expected")).alias("excess"), ((F.col("mean") - F.col("expected")) / spread).alias("z"))


def sampled_seeds(candidates: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` of the candidates (``id``, ``twin``) by a hash: at most a third of them twins, or one, the rest others."""
    order = [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), F.col("id")]
    twins = candidates.where("twin").orderBy(*order).limit(max(1, n // 3))
    others = candidates.where("NOT twin").orderBy(*order).limit(n)
    place = F.row_number().over(Window.orderBy(*order))  # of at most n rows
    taken = twins.agg(F.count(F.lit(1)).alias("taken"))
    rest = others.withColumn("place", place).crossJoin(F.broadcast(taken)).where(F.col("place") <= n - F.col("taken"))
    return twins.unionByName(rest.select(*twins.columns))


def swept(pairs: DataFrame, configs: dict[str, tuple[str, list[float]]], k: int) -> DataFrame:
    """The ``k`` nearest of each seed under each of several metrics (``cosine`` or ``euclidean``) and weights of the dimensions, all in one pass."""

    def closeness_by(metric: str, weights: list[float]) -> Column:
        a, b = F.col("seed_vector"), F.col("vector")
        if metric == "euclidean":
            return -vectors.weighted_distance(a, b, weights)
        w = F.array(*map(F.lit, weights))
        a, b = (F.zip_with(x, w, lambda p, q: p * q) for x in (a, b))
        return vectors.dot(a, b) / (F.greatest(vectors.norm(a), F.lit(1e-9)) * F.greatest(vectors.norm(b), F.lit(1e-9)))

    scores = F.array(*[F.struct(F.lit(name).alias("config"), F.round(closeness_by(*c), 9).alias("score")) for name, c in configs.items()])
    each = pairs.select("seed_id", "id", F.explode(scores).alias("x")).select("seed_id", "id", "x.*")
    order = Window.partitionBy("config", "seed_id").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Albums of so few and so many rows count as labels, and so many mates of an artist.
ALBUM_LEAST, ALBUM_MOST, ARTIST_MATES = 2, 25, 20
RING = 1000


def label_pairs(rows: DataFrame, placeholder: Column, mates: int = ARTIST_MATES) -> DataFrame:
    """Positive labels of (``id``, ``artist``, ``album``): ``kind`` album or artist, ``id`` and ``mate``.

    Rows of an album of 2 to 25 are each other's mates, but for placeholder albums.
    An artist's rows have up to ``mates`` mates each: all others in a small group, in a
    larger one those that follow on a ring in order of a hash.  Rings have some thousand
    rows of an artist, so that one with most of the rows is spread, and no square of an
    artist is made.  Rows without an artist have no mates.
    """
    clean = rows.select("id", F.trim(F.coalesce("artist", F.lit(""))).alias("artist"), F.trim(F.coalesce("album", F.lit(""))).alias("album"), placeholder.alias("vague")).where("artist <> ''")
    albums = clean.where("album <> '' AND NOT coalesce(vague, false)")
    counts = albums.groupBy("artist", "album").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(ALBUM_LEAST, ALBUM_MOST)).drop("n")
    fit = albums.join(counts, ["artist", "album"]).select("artist", "album", "id")
    album_pairs = fit.join(fit.withColumnRenamed("id", "mate"), ["artist", "album"]).where("id <> mate").select(F.lit("album").alias("kind"), "id", "mate")
    sizes = clean.groupBy("artist").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rings = F.when(F.col("n") <= mates + 1, F.lit(1)).otherwise(F.ceil(F.col("n") / RING))
    dealt = clean.join(sizes, "artist").withColumn("ring", F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("ring:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long"), rings))
    ring = Window.partitionBy("artist", "ring")
    placed = dealt.select("artist", "ring", "id", F.row_number().over(ring.orderBy(F.md5(F.col("id").cast("string")), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("place"), F.count(F.lit(1)).over(ring).alias("m"))
    asked = placed.where("m > 1").withColumn("step", F.explode(F.sequence(F.lit(1), F.least(F.lit(mates), F.col("m") - 1).cast("int"))))
    asked = asked.select("artist", "ring", "id", (F.pmod(F.col("place") - 1 + F.col("step"), F.col("m")) + 1).alias("place"))
    artist_pairs = asked.join(placed.select("artist", "ring", "place", F.col("id").alias("mate")), ["artist", "ring", "place"]).select(F.lit("artist").alias("kind"), "id", "mate")
    return album_pairs.unionByName(artist_pairs)


def ranked_letters(rankings: DataFrame, key: str, ranking: str) -> DataFrame:
    """``key``, ``place`` and ``letter`` of rankings like "B>A=C": better before ">", equals at one place."""
    groups = rankings.select(key, F.posexplode(F.split(ranking, ">")).alias("k", "grp"))
    return groups.select(key, (F.col("k") + 1).alias("place"), F.explode(F.split("grp", "=")).alias("letter"))


def outside(seeds: DataFrame, seed: str, collection: DataFrame, key: str) -> DataFrame:
    """The seeds that are not in a collection, which would bring a row from outside it into a list."""
    return seeds.join(collection.select(F.col(key).alias(seed)), seed, "left_anti")
