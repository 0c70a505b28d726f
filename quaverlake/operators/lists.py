"""Order-aware list builders.

Rankings are DataFrames (``seed_id``, ``rank``, ``id``, ``artist``, ``score``); a walk
takes a ranking's head, bounded by rank, and folds over it.  Where the head does not
fill a list, ``filled_walk`` takes a longer one, until it does or the pool is used up.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors

MEMBER = "struct<id:bigint,artist:string,score:double,rank:int>"


def ranked(scores: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds ``rank`` within each seed: best score first, then the lesser id."""
    order = Window.partitionBy("seed_id").orderBy(F.desc("score"), "id")
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if limit is None else out.where(F.col("rank") <= limit)


def spaced(head: Column, size: int, spacing: int) -> Column:
    """Folds an ordered array of members: an artist among the last ``spacing`` accepted is passed over for good.

    A spacing of 0 looks back over the whole list; null and empty artists never conflict.
    """

    def take(out: Column, x: Column) -> Column:
        recent = out if spacing == 0 else F.slice(out, F.greatest(F.size(out) - spacing + 1, F.lit(1)), spacing)
        blocked = F.exists(recent, lambda m: (m["artist"] == x["artist"]) & (x["artist"] != ""))
        return F.when((F.size(out) >= size) | F.coalesce(blocked, F.lit(False)), out).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(head, F.array().cast(f"array<{MEMBER}>"), take)


def walk(ranking: DataFrame, size: int, spacing: int) -> DataFrame:
    """``position``, ``id``, ``artist``, ``score`` and ``rank`` of each seed's list."""
    members = F.struct(F.col("id").cast("bigint").alias("id"), F.col("artist").cast("string").alias("artist"), "score", F.col("rank").cast("int").alias("rank"))
    heads = ranking.groupBy("seed_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("k"), members.alias("m")))).alias("head"))
    lists = heads.select("seed_id", spaced(F.transform("head", lambda x: x["m"]), size, spacing).alias("list"))
    return lists.select("seed_id", F.posexplode("list").alias("position", "m")).select(
        "seed_id", (F.col("position") + 1).alias("position"), "m.id", "m.artist", "m.score", "m.rank"
    )


def filled_walk(scores: DataFrame, size: int, spacing: int, first: int | None = None) -> DataFrame:
    """``walk`` over as long a head as fills every list, or over all of the pool."""
    limit = first or size * (spacing + 1) * 4
    pools = {r["seed_id"]: r["n"] for r in scores.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    while True:
        out = walk(ranked(scores, limit), size, spacing)
        got = {r["seed_id"]: r["n"] for r in out.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        if all(got.get(s, 0) >= size or n <= limit for s, n in pools.items()):
            return out
        limit *= 4


def grown(ranking: DataFrame, build: Callable[[DataFrame], DataFrame], done: Column, limit: int) -> tuple[DataFrame, int]:
    """``build`` over as long a head as is ``done`` (an aggregate) for each seed, or over all of the pool; and that head's length."""
    pools = {r["seed_id"]: r["n"] for r in ranking.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    while True:
        out = build(ranking.where(F.col("rank") <= limit))
        got = {r["seed_id"]: r["done"] for r in out.groupBy("seed_id").agg(done.alias("done")).collect()}
        if all(got.get(s) or n <= limit for s, n in pools.items()):
            return out, limit
        limit *= 4


REPORT = "seed_id long, id long, rank int, score double, fit double, position int, status string"


def walk_report(ranking: DataFrame, size: int, spacing: int, line: float | None = None, floor: int = 0, variety: float = 0.0, twin: str | None = None, recording: str | None = None, ceiling: dict[int, float] | None = None, first: int | None = None) -> DataFrame:
    """What a walk does with each candidate it reaches.

    ``status`` is taken, past (taken below the line to reach the floor), coin, fit,
    duplicate, artist, recording or left.  Tests come in that order of a walk: the line
    (which ends it, once the floor is met), the coin, the twin, the artist, the
    recording.  Passed-over fitting candidates come back first, best first, when the
    line is reached below the floor.
    """
    extra = [c for c in (twin, recording) if c]
    coined = ranking.withColumn("toss", text.hash_unit(F.lit("coin"), F.col("seed_id"), F.col("id")))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        seed = int(rows["seed_id"].iloc[0])
        top = (ceiling or {}).get(seed, 1.0)
        top = top if top > 1e-9 else 1.0
        keep = 1.0 / (1.0 + variety) if variety > 0 else 1.0
        out, artists, seen = [], [], {c: set() for c in extra}
        result: dict[int, tuple[str, int | None]] = {}
        passed: list[int] = []
        records = rows.to_dict("records")

        def test(i: int, status: str) -> None:
            r = records[i]
            if twin and r[twin] is not None and r[twin] in seen[twin]:
                result[i] = ("duplicate", None)
            elif r["artist"] and r["artist"] in (artists[-spacing:] if spacing else artists):
                result[i] = ("artist", None)
            elif recording and r[recording] is not None and r[recording] in seen[recording]:
                result[i] = ("recording", None)
            else:
                out.append(i)
                artists.append(r["artist"])
                for c in extra:
                    seen[c].add(r[c])
                result[i] = (status, len(out))

        below = ended = False
        for i, r in enumerate(records):
            if line is not None and r["score"] / top < line:
                if not below:
                    below = True
                    for j in passed:
                        if len(out) >= min(floor, size):
                            break
                        test(j, "taken")
                if len(out) >= floor:
                    result[i] = ("fit", None)
                    ended = True
                    break
                test(i, "past")
            elif variety > 0 and r["toss"] >= keep:
                passed.append(i)
                result[i] = ("coin", None)
            else:
                test(i, "taken")
            if len(out) >= size or below and len(out) >= floor:
                ended = True
                break
        told = [(*result.get(i, ("left", None)), r) for i, r in enumerate(records)]
        return pd.DataFrame(
            {
                "seed_id": seed,
                "id": [r["id"] for _, _, r in told],
                "rank": [r["rank"] for _, _, r in told],
                "score": [r["score"] for _, _, r in told],
                "fit": [r["score"] / top for _, _, r in told],
                "position": pd.array([p for _, p, _ in told], dtype="Int32"),
                "status": [s for s, _, _ in told],
                "ended": ended,
            }
        )

    head, limit = grown(coined, lambda rows: rows.groupBy("seed_id").applyInPandas(one, REPORT + ", ended boolean"), F.max("ended"), first or size * (spacing + 1) * 4)
    # what lies past the head is left by every walk that ended in it; the others had all of their pool
    tops = [F.when(F.col("seed_id") == s, F.lit(float(t))) for s, t in (ceiling or {}).items() if t > 1e-9]
    left = ranking.where(F.col("rank") > limit).select(
        F.col("seed_id").cast("long"), F.col("id").cast("long"), F.col("rank").cast("int"), "score", (F.col("score") / F.coalesce(*tops, F.lit(1.0))).alias("fit"),
        F.lit(None).cast("int").alias("position"), F.lit("left").alias("status"),
    )
    return head.drop("ended").unionByName(left)


#: How wide the pool of a varied mix is at most, in sizes, and the scale of ranks in its weights.
WIDEST, STEEPEST, FLATTER, MOST_VARIETY = 8, 3.0, 30.0, 9.0


def sampled_mix(ranking: DataFrame, size: int, spacing: int, variety: str = "variety", draw: str = "draw") -> DataFrame:
    """The baseline mix of rankings with a ``variety`` from 0 to 9: without it the spaced walk, else a weighted sample.

    The pool is the first 1 to 8 times ``size`` rows, and weights fall with the rank,
    exp(-rank / (3 + 30 v)).  Drawing without replacement by weights is the order of
    exponential keys, -ln(u) / weight, with u a hash of draw, seed and row: one sort
    instead of a draw at a time.  A row too close to the last ``spacing`` artists is
    passed over while enough rows are left to fill the list.  A spacing of 0 restricts
    nothing here.  The walk without variety goes as far down its ranking as it takes to
    fill the list.
    """
    v = F.greatest(F.least(F.col(variety).cast("double"), F.lit(MOST_VARIETY)), F.lit(0.0)) / MOST_VARIETY
    rows = ranking.withColumn("v", v)
    wide = rows.where((F.col("v") > 0) & (F.col("rank") <= size * (1 + F.bround(F.col("v") * (WIDEST - 1)))))
    u = text.hash_unit(F.lit("draw"), F.col(draw), F.col("seed_id"), F.col("id")) + 2.0**-33
    wide = wide.withColumn("key", -F.log(u) / F.exp(-(F.col("rank") - 1) / (STEEPEST + FLATTER * F.col("v"))))
    # without variety the order is the rank, and nothing is taken for want of rows
    plain = rows.where("v = 0").withColumn("key", F.col("rank").cast("double"))
    group = ["seed_id", draw, variety]
    member = F.struct(F.col("key"), F.col("id").cast("bigint").alias("id"), F.col("artist").cast("string").alias("artist"), F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))
    state = F.struct(F.lit(0).alias("drawn"), F.array().cast("array<struct<key:double,id:bigint,artist:string,score:double,rank:int>>").alias("out"))
    n = F.size("head")

    def take(s: Column, x: Column) -> Column:
        out, drawn = s["out"], s["drawn"] + 1
        recent = F.slice(out, F.greatest(F.size(out) - spacing + 1, F.lit(1)), spacing) if spacing > 0 else F.slice(out, 1, 0)
        close = F.coalesce(F.exists(recent, lambda m: (m["artist"] == x["artist"]) & (x["artist"] != "")), F.lit(False))
        enough = (F.col("v") == 0) | (n - drawn + F.size(out) > size)
        return F.struct(drawn.alias("drawn"), F.when((F.size(out) >= size) | (close & enough), out).otherwise(F.concat(out, F.array(x))).alias("out"))

    def listed(heads: DataFrame) -> DataFrame:
        gathered = heads.groupBy(*group).agg(F.array_sort(F.collect_list(member)).alias("head"), F.max("v").alias("v"))
        return gathered.select(*group, F.aggregate("head", state, take, lambda s: s["out"]).alias("out"), F.size("head").alias("n"))

    # a list that is not full and whose ranking goes on takes a longer head
    limit = size * (max(spacing, 0) + 1) * 4
    longest = plain.agg(F.max("rank")).first()[0] or 0
    strict = listed(plain.where(F.col("rank") <= limit))
    while limit < longest and not strict.where((F.size("out") < size) & (F.col("n") >= limit)).isEmpty():
        limit *= 4
        strict = listed(plain.where(F.col("rank") <= limit))
    lists = listed(wide).unionByName(strict)
    return lists.select(*group, F.posexplode("out").alias("position", "m")).select(*group, (F.col("position") + 1).alias("position"), "m.id", "m.artist", "m.score", "m.rank")


ENERGY_WIDTH = 0.35
ENERGY_PERIOD = 20


def arc(kind: str, accepted: int, position: int = 0) -> float:
    """The energy wanted after so many accepted items, from -1 to 1."""
    phase = ((position + accepted) % ENERGY_PERIOD) / ENERGY_PERIOD
    return {"flat": 0.0, "rise": 2 * phase - 1, "fall": 1 - 2 * phase, "wave": float(np.sin(2 * np.pi * phase))}[kind]


def radio(ranking: DataFrame, size: int, spacing: int, variety: float, kind: str = "flat", position: int = 0, energy: str | None = None, first: int | None = None) -> DataFrame:
    """A queue with one coin a candidate, and one for its energy against the arc; without variety it is a plain walk."""
    if variety <= 0:
        return walk(ranking, size, spacing)
    limit, filled = first or size * (spacing + 1) * 4, F.count(F.lit(1)) >= size
    tossed = ranking.withColumn("toss", text.hash_unit(F.lit("radio"), F.col("seed_id"), F.col("id")))
    if energy is None:
        return grown(tossed, lambda head: walk(head.where(F.col("toss") < 1.0 / (1.0 + variety)), size, spacing), filled, limit)[0]
    tossed = tossed.withColumn("toss2", text.hash_unit(F.lit("energy"), F.col("seed_id"), F.col("id")))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        taken, artists = [], []
        for r in rows.sort_values("rank").to_dict("records"):
            if len(taken) >= size:
                break
            if r["toss"] >= 1.0 / (1.0 + variety):
                continue
            z = (r[energy] - arc(kind, len(taken), position)) / ENERGY_WIDTH
            if not np.isnan(z) and r["toss2"] >= np.exp(-z * z / 2):
                continue
            if r["artist"] and r["artist"] in (artists[-spacing:] if spacing else artists):
                continue
            taken.append(r)
            artists.append(r["artist"])
        if not taken:  # Spark takes no empty frame here: a row of position 0 stands for it
            return pd.DataFrame({"seed_id": [rows["seed_id"].iloc[0]], "id": [0], "artist": [""], "score": [0.0], "rank": [0], "position": [0]})
        return pd.DataFrame({c: [r[c] for r in taken] for c in ("seed_id", "id", "artist", "score", "rank")}).assign(position=range(1, len(taken) + 1))

    schema = "seed_id long, id long, artist string, score double, rank int, position int"
    out, _ = grown(tossed, lambda head: head.where(F.col("toss") < 1.0 / (1.0 + variety)).groupBy("seed_id").applyInPandas(one, schema).where("position > 0"), filled, limit)
    return out.select("seed_id", "position", "id", "artist", "score", "rank")


def spread_of(rel: np.ndarray, x: np.ndarray, k: int, balance: float) -> list[int]:
    """Places of ``k`` rows by maximal marginal relevance, the first row first; ``rel`` has its greatest value there."""
    if not len(rel):
        return []
    sims = np.round(x @ x.T, 9)
    chosen, nearest = [0], sims[:, 0].copy()
    while len(chosen) < min(k, len(rel)):
        value = np.round(balance * rel - (1 - balance) * nearest, 9)
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
        nearest = np.maximum(nearest, sims[:, chosen[-1]])
    return chosen


def flow_of(x: np.ndarray, ids: list[int]) -> list[int]:
    """Places of rows so that each is followed by the nearest of those left, the lesser id on a tie."""
    sims = np.round(x @ x.T, 9)
    at, left = [0], list(range(1, len(ids)))
    while left:
        nearest = max(left, key=lambda j: (sims[at[-1], j], -ids[j]))
        at.append(nearest)
        left.remove(nearest)
    return at


def diverse(candidates: DataFrame, k: int, balance: float) -> DataFrame:
    """Maximal marginal relevance over (``seed_id``, ``id``, ``score``, ``vector``): ``balance`` weighs relevance."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        chosen = spread_of(rows["score"].to_numpy(), np.array(rows["vector"].tolist(), dtype=np.float64), k, balance)
        return rows.iloc[chosen][["seed_id", "id", "score"]].assign(position=range(1, len(chosen) + 1))

    return candidates.groupBy("seed_id").applyInPandas(one, "seed_id long, id long, score double, position int")


def by_flow(members: DataFrame) -> DataFrame:
    """Greedy nearest neighbour from the first of (``seed_id``, ``position``, ``id``, ``vector``)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position").reset_index(drop=True)
        at = flow_of(np.array(rows["vector"].tolist(), dtype=np.float64), rows["id"].tolist())
        return pd.DataFrame({"seed_id": rows["seed_id"], "position": range(1, len(at) + 1), "id": rows["id"].iloc[at].tolist()})

    return members.groupBy("seed_id").applyInPandas(one, "seed_id long, position int, id long")


def adventure(pool: DataFrame, start: int, end: int, size: int, spacing: int = 3, line: float | None = None, head: int | None = None) -> DataFrame:
    """A path from one item to another over (``id``, ``artist``, ``vector``) of unit length.

    Each stop between takes the best unused item for its point on the straight line.
    All used items together are fewer than ``size``, so the best ``size + spacing + 1``
    of each stop hold every item that the path can want.
    """
    size = max(3, size)
    if start == end:
        raise ValueError("a path needs two different ends")
    ends = {r["id"]: (r["artist"], r["vector"]) for r in pool.where(F.col("id").isin(start, end)).select("id", "artist", vectors.doubles(F.col("vector")).alias("vector")).collect()}
    a, b = (np.array(ends[i][1]) for i in (start, end))
    points = np.array([(1 - t) * a + t * b for t in np.linspace(0, 1, size)[1:-1]])
    points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    stops = F.array(*[F.struct(F.lit(k).cast("long").alias("seed_id"), F.array(*map(F.lit, p.tolist())).alias("point")) for k, p in enumerate(points)])
    scores = pool.where(~F.col("id").isin(start, end)).select("id", "artist", "vector", F.explode(stops).alias("stop")).select(
        "stop.seed_id", "id", "artist", F.round(vectors.dot(F.col("vector"), F.col("stop.point")), 9).alias("score")
    )
    # past each used item and each artist of the spacing there may be further rows to pass over
    heads = ranked(scores, head or 4 * (size + spacing + 1)).withColumn("path", F.lit(0))
    first = ends[start][0]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        used, recent, path = set(), [first], [(start, None)]
        for _, stop in rows.sort_values(["seed_id", "rank"]).groupby("seed_id"):
            free = [r for r in stop.to_dict("records") if r["id"] not in used][: spacing + 1]
            fits = free if line is None else [r for r in free if r["score"] >= line]
            if not fits:
                continue
            pick = next((r for r in fits if not r["artist"] or r["artist"] not in recent[-spacing:]), fits[0])
            used.add(pick["id"])
            recent.append(pick["artist"])
            path.append((pick["id"], pick["score"]))
        path.append((end, None))
        return pd.DataFrame({"position": range(1, len(path) + 1), "id": [p for p, _ in path], "score": [s for _, s in path]})

    return heads.groupBy("path").applyInPandas(one, "position int, id long, score double")


def steered(base: Column, liked: Column | None, disliked: Column | None, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15) -> Column:
    """A query vector moved toward liked and away from disliked centroids, of unit length."""
    out = vectors.scaled(base, F.lit(alpha))
    if liked is not None:
        out = vectors.added(out, vectors.scaled(liked, F.lit(beta)))
    if disliked is not None:
        out = vectors.less(out, vectors.scaled(disliked, F.lit(gamma)))
    return vectors.unit(out)
