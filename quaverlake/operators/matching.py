"""Entity matching between catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .shared import kept, merged

NEAR_SECONDS, FAR_SECONDS = 2.0, 8.0
#: Fixed value: words of other versions of a song.
VERSION_WORDS = r"\b(live|remix|karaoke|instrumental|acoustic|demo|edit)\b"
TIERS = ("basename", "artist+title", "title-only")


#: Seconds of a band: the nearest duration is looked for within a band, and carried from band to band.
BAND = 32
UNKNOWN_DRIFT, TIED_SECONDS = 999.0, 0.5


def keyed(df: DataFrame) -> DataFrame:
    """The columns that matching compares: ``base``, ``a``, ``t``, ``al``, and ``x``, the seconds where they are known."""
    keys = {"base": F.lower(text.basename(F.col("path"))), "a": text.match_key(F.col("artist")), "t": text.match_key(F.col("title")), "al": text.match_key(F.col("album"))}
    return df.select("id", "path", F.when(F.col("seconds") > 0, F.col("seconds").cast("double")).alias("x"), *[k.alias(n) for n, k in keys.items()])


def inside_artists(one: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of the artist keys of two sides where one holds the other: equal joins on all substrings of each distinct key."""
    names = [df.select(F.col("a").alias(n)).where("a <> ''").distinct() for df, n in ((one, "a"), (other, "b"))]
    cuts = "explode(flatten(transform(sequence(1, length({0})), i -> transform(sequence(1, length({0}) - i + 1), n -> substring({0}, i, n)))))"
    short_first = names[0].join(names[1].select("b", F.expr(cuts.format("b")).alias("a")).distinct(), "a")
    long_first = names[0].select("a", F.expr(cuts.format("a")).alias("b")).distinct().join(names[1], "b")
    return short_first.select("a", "b").unionByName(long_first.select("a", "b")).distinct()


def scopes(source: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``tier_no`` and ``scope``: rows of one scope are candidates of each other.

    The tiers are equal file names, equal artist and title, equal title with one artist inside the other.
    """
    pair = lambda a: F.concat_ws("|", a, "t")
    named = (F.col("a") != "") & (F.col("t") != "")
    tiers = ((F.col("base"), F.lit(True)), (pair("a"), named), (pair("a"), named))
    own = [F.struct(F.lit(k).alias("tier_no"), F.when(ok, key).alias("scope")) for k, (key, ok) in enumerate(tiers)]
    of = lambda df, tiers: df.withColumn("s", F.explode(F.array(*tiers))).select("*", "s.*").drop("s").where("scope IS NOT NULL")
    # a catalog row is a candidate of the third tier for each artist key of the sources inside its own, or around it
    links = inside_artists(source, catalog).select(F.col("a").alias("__a"), F.col("b").alias("a"))
    third = catalog.where("t <> ''").join(links, "a").select(*catalog.columns, F.lit(2).alias("tier_no"), F.concat_ws("|", "__a", "t").alias("scope"))
    return of(source, own), of(catalog, own[:2]).unionByName(third)


def nearest_durations(asked: DataFrame, offered: DataFrame, keys: list[str]) -> DataFrame:
    """Of each asked row (``keys``, ``x``, ``ask``) the nearest offered ``x`` to both sides, as (x, ``pick``) in ``below`` and ``above``.

    An as-of join without pairs: both sides lie in one order within bands of ``x``, and
    the ends of bands are carried over the bands of a key.
    """
    banded = lambda df: df.withColumn("band", F.floor(F.col("x") / BAND))
    asked, offered = banded(asked), banded(offered)
    point = F.struct("x", "pick")
    both = asked.select(*keys, "band", "x", "ask", F.lit(None).cast(offered.schema["pick"].dataType).alias("pick")).unionByName(
        offered.select(*keys, "band", "x", F.lit(None).cast(asked.schema["ask"].dataType).alias("ask"), "pick")
    )
    within = Window.partitionBy(*keys, "band")
    seen = F.last(F.when(F.col("pick").isNotNull(), point), ignorenulls=True)
    # offered rows come first among equals, in either order
    order = F.col("ask").isNotNull()
    found = both.withColumn("below", seen.over(within.orderBy("x", order))).withColumn("above", seen.over(within.orderBy(F.desc("x"), order))).where("ask IS NOT NULL")
    ends = offered.groupBy(*keys, "band").agg(F.max(point).alias("high"), F.min(point).alias("low"))
    bands = merged(asked.select(*keys, "band").distinct(), ends, [*keys, "band"], "full_outer")
    over = Window.partitionBy(*keys)
    before = F.last("high", ignorenulls=True).over(over.orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("low", ignorenulls=True).over(over.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1))
    carried = bands.select(*keys, "band", before.alias("before"), after.alias("after"))
    return merged(found, carried, [*keys, "band"], "left").select(*keys, "ask", F.coalesce("below", "before").alias("below"), F.coalesce("above", "after").alias("above"))


def resolve(source: DataFrame, catalog: DataFrame) -> DataFrame:
    """The best candidate of each source row, with its tier, grade, drift and ties; null where there is none.

    Both sides have ``id``, ``path``, ``artist``, ``title``, ``album`` and ``seconds``.
    Candidates of a tier go by how near their duration is (2 seconds, 8, or beyond), then
    by a penalty (another album than the source's, various artists, another version),
    the drift, the path and the id.  The first tier with a candidate near in duration
    wins, else the least drift of the tiers' best.

    Candidates of one penalty differ by drift alone, so of each only the nearest to both
    sides can be best, which an as-of join finds; ties are added up from counts by
    duration.  No pairs of a title are made.
    """
    asks, offers = scopes(kept(keyed(source), "source-keys"), kept(keyed(catalog), "catalog-keys"))
    flag = lambda c: F.when(c, 1).otherwise(0)
    kind = flag(F.col("a") == "various artists") * 2 + flag(F.col("t").rlike(VERSION_WORDS))
    offers = offers.withColumns({"kind": kind, "pick": F.struct("path", "id")}).select("tier_no", "scope", "al", "kind", "x", "pick")
    # by album, and once more whatever the album: the empty one, which no source compares
    spread = offers.withColumn("al", F.explode(F.array_distinct(F.array(F.lit(""), "al"))))
    keys = ["tier_no", "scope", "al", "kind"]
    points = kept(spread.groupBy(*keys, "x").agg(F.min("pick").alias("pick"), F.count(F.lit(1)).alias("n")), "durations")
    asked = asks.select("id", "tier_no", "scope", "x", F.explode(F.array_distinct(F.array(F.lit(""), "al"))).alias("al"))
    asked = merged(asked, points.select(*keys).distinct(), ["tier_no", "scope", "al"]).select(*keys, "x", F.struct("id", "x").alias("ask"))
    timed = nearest_durations(asked.where("x IS NOT NULL"), points.where("x IS NOT NULL"), keys)
    sides = F.explode(F.array(*[F.struct((F.abs(F.col(f"{c}.x") - F.col("ask.x"))).alias("drift"), F.col(f"{c}.pick").alias("pick")) for c in ("below", "above")]))
    timed = timed.withColumn("found", sides).where("found.pick IS NOT NULL").select(*keys, "ask", "found.*")
    # a duration that is not known on either side is as far as can be
    blank = points.withColumn("blank", F.col("x").isNull()).groupBy(*keys, "blank").agg(F.min("pick").alias("pick"), F.sum("n").alias("n"))
    untimed = merged(asked, blank, keys).where("blank OR ask.x IS NULL").select(*keys, "ask", F.lit(UNKNOWN_DRIFT).alias("drift"), "pick")
    bucket = F.when(F.col("drift") <= NEAR_SECONDS, 0).when(F.col("drift") <= FAR_SECONDS, 1).otherwise(2)
    penalty = flag(F.col("al") != "") * -2.0 + F.floor(F.col("kind") / 2) * 1.5 + F.col("kind") % 2
    every = timed.unionByName(untimed).withColumns({"bucket": bucket, "penalty": penalty})
    best = every.groupBy("ask", "tier_no").agg(F.min(F.struct("bucket", "penalty", "drift", "pick", "scope", "al", "kind")).alias("head")).select("ask", "tier_no", "head.*")
    # among tiers: the first near one, else the least drift, the earlier tier on a tie
    near = F.when(F.col("bucket") == 0, F.col("tier_no")).otherwise(9)
    fields = [c for c in best.columns if c not in ("ask", "tier_no")]
    chosen = kept(best.groupBy("ask").agg(F.min_by(F.struct("tier_no", *fields), F.struct(near, "drift", "tier_no")).alias("c")).select("ask", "c.*"), "chosen")
    grade = (
        F.when(F.col("bucket") == 0, F.element_at(F.array(F.lit("exact"), F.lit("strong"), F.lit("probable")), F.col("tier_no") + 1))
        .when(F.col("bucket") == 1, "probable").otherwise("weak")
    )
    tier = F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier_no") + 1)
    told = merged(chosen, tied_candidates(chosen, points, asks), "ask", "left").select(
        F.col("ask.id").alias("id"), F.col("pick.id").alias("match_id"), tier.alias("tier"), grade.alias("grade"), F.round("drift", 2).alias("drift"), (F.coalesce("tied", F.lit(1)) - 1).alias("ties")
    )
    return merged(source.select("id"), told, "id", "left")


def tied_candidates(chosen: DataFrame, points: DataFrame, asks: DataFrame) -> DataFrame:
    """How many candidates, the best included, share its bucket and penalty and are within half a second of its drift.

    Durations around both places that are that far off are looked up by whole seconds,
    each with the number of candidates.  Where the best has another album than the
    source, candidates of the source's album are counted and taken off.
    """
    own_album = asks.select("id", F.col("al").alias("own")).distinct()
    looked = merged(chosen, own_album, F.col("ask.id") == own_album["id"]).drop("id")
    looked = looked.withColumn("album", F.explode(F.when(F.col("al") != "", F.array("al")).otherwise(F.array_distinct(F.array(F.lit(""), "own"))))).withColumn("sign", F.when((F.col("al") == "") & (F.col("album") != ""), -1).otherwise(1))
    places = F.array(*[F.floor(F.col("ask.x") + side * F.col("drift") + step) for side in (-1, 1) for step in (-1, 0, 1)])
    known = F.col("ask.x").isNotNull()
    # at 999, candidates without a duration tie too; a source without one ties with all
    cells = F.when(known & (F.abs(F.col("drift") - UNKNOWN_DRIFT) < TIED_SECONDS), F.array_append(F.array_distinct(places), F.lit(-1))).when(known, F.array_distinct(places)).otherwise(F.array(F.lit(-2)))
    asked = looked.withColumn("cell", F.explode(cells)).select("ask", "tier_no", "scope", F.col("album").alias("al"), "kind", "cell", "sign", "drift", "bucket")
    offered = points.select("tier_no", "scope", "al", "kind", F.col("x").alias("at"), "n", F.explode(F.array(F.coalesce(F.floor("x"), F.lit(-1)), F.lit(-2))).alias("cell"))
    # of a source without duration all candidates of a kind are tied: their sum is a row
    whole = offered.where("cell = -2").groupBy("tier_no", "scope", "al", "kind", "cell").agg(F.lit(None).cast("double").alias("at"), F.sum("n").alias("n"))
    met = merged(asked, offered.where("cell <> -2").select(*whole.columns).unionByName(whole), ["tier_no", "scope", "al", "kind", "cell"])
    drift = F.coalesce(F.abs(F.col("at") - F.col("ask.x")), F.lit(UNKNOWN_DRIFT))
    bucket = F.when(drift <= NEAR_SECONDS, 0).when(drift <= FAR_SECONDS, 1).otherwise(2)
    same = (bucket == F.col("bucket")) & (F.abs(drift - F.col("drift")) < TIED_SECONDS)
    return met.where(same).groupBy("ask").agg(F.sum(F.col("sign") * F.col("n")).alias("tied"))


def report(source: DataFrame, resolved: DataFrame) -> DataFrame:
    """What becomes of each source row of a folder: its ``matches`` row with ``outcome`` and ``flagged``, and ``same_as`` of a duplicate.

    In order of path the first row that finds a track has it (resolved); later ones are
    duplicates of it, and rows without a match are the residue.  A resolved row is
    flagged where its grade is below strong or candidates tied.
    """
    rows = merged(source.select("id", "path"), resolved, "id")
    claims = rows.where("match_id IS NOT NULL").groupBy("match_id").agg(F.min(F.struct("path", "id")).alias("claim"))
    met = merged(rows, claims, "match_id", "left")
    first = F.col("claim.id") == F.col("id")
    outcome = F.when(F.col("match_id").isNull(), "residue").when(first, "resolved").otherwise("duplicate")
    flagged = (outcome == "resolved") & (F.col("grade").isin("probable", "weak") | (F.col("ties") > 0))
    return met.select("id", "path", "match_id", "tier", "grade", "drift", "ties", outcome.alias("outcome"), flagged.alias("flagged"), F.when(outcome == "duplicate", F.col("claim.path")).alias("same_as"))


def report_counts(rows: DataFrame) -> DataFrame:
    """One row: source rows, resolved, residue, flagged, duplicates, and resolved by grade."""
    of = lambda c: F.count_if(c)
    resolved = F.col("outcome") == "resolved"
    grades = [of(resolved & (F.col("grade") == g)).alias(g) for g in ("exact", "strong", "probable", "weak")]
    return rows.agg(
        F.count(F.lit(1)).alias("source"), of(resolved).alias("resolved"), of(F.col("outcome") == "residue").alias("residue"), of(F.col("flagged")).alias("flagged"), of(F.col("outcome") == "duplicate").alias("dupes"), *grades
    )


def second_copy(existing: DataFrame, incoming: DataFrame, path: str, sample: int = 400, least: int = 20, share: float = 0.8) -> DataFrame:
    """Whether an import looks like a second copy: of a sample even by the paths' hashes, ``hits`` share the last three components of a known path."""
    new = incoming.join(existing, path, "left_anti").select(path).distinct()
    total = new.count()
    step = max(1, total // sample)
    picked = new.where(F.pmod(F.crc32(F.col(path).cast("binary")), F.lit(step)) == 0).select(text.tail_key(F.col(path)).alias("tail"))
    known = existing.select(text.tail_key(F.col(path)).alias("tail")).distinct().withColumn("known", F.lit(True))
    out = picked.join(known, "tail", "left").agg(F.count(F.lit(1)).alias("sampled"), F.count_if("known").alias("hits"))
    return out.withColumn("second_copy", (F.lit(total) >= least) & (F.col("hits") >= least) & (F.col("hits") >= share * F.col("sampled")))
