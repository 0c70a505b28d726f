"""Mix requests: the whole walk, what the route does after it, why a list stops, and the trace.

Spark scores and ranks the pool for all requests at once and keeps the head that a walk
can reach; the walk itself is a fold over that head by rank, request by request, which
holds what it has taken and not the head.  A head that turns out too short grows for its
request until the walk has ended or the pool is used up.
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from .lists import flow_of, spread_of
from .shared import kept

#: The share of the count that a list with a line keeps at least, and what a re-pick for variety draws from.
FLOOR_SHARE, VARIETY_POOL, VARIETY_BALANCE, NEXT, MOST_LEFT, MOST_FIELD = 0.5, 200, 0.3, 10, 40, 600


@dataclass(frozen=True)
class Request:
    """``seed`` asks for ``size`` items.  ``line`` is the least fit, below which a list ends; ``mask`` names a boolean column of the pool."""

    number: int
    seed: int
    size: int = 25
    spacing: int = 3
    line: float | None = None
    floor_share: float = FLOOR_SHARE
    thin: float = 0.0
    dedup: bool = False
    variety: bool = False
    flow: bool = False
    bans: tuple[int, ...] = ()
    banned_artists: tuple[str, ...] = ()
    mask: str | None = None

    @property
    def floor(self) -> int | None:
        return None if self.line is None or self.floor_share <= 0 else max(1, math.ceil(self.size * min(1.0, self.floor_share)))

    @property
    def wanted(self) -> int:
        """How many items the walk looks for, so that the size survives what comes after it."""
        n = VARIETY_POOL if self.variety else min(self.size * 4, VARIETY_POOL) if self.dedup else self.size
        return min(max(n * 3, n + 60), 400) if self.bans or self.banned_artists else n

    @property
    def walk_floor(self) -> int | None:
        """The walk's floor grows as its count does."""
        if self.floor is None or self.wanted <= self.size:
            return self.floor
        return min(self.wanted, self.floor + self.wanted - self.size)


ROW = ("id", "rank", "score", "fit", "toss", "artist", "twin", "recording", "song", "vector", "seed_twin", "seed_recording", "seed_song")
Row = namedtuple("Row", ROW)


class Walk:
    """Best first over candidates: the line, the coin, the same song again, the artist's spacing, the same recording.

    The seed's own song and recording count from the start.  Below the line, which ends
    the walk, items are taken only up to the floor: first those that the coin passed
    over, then the next best.

    Candidates come one by one (``feed``), and only what can still matter is held: the
    items taken, those that the coin passed over while a floor may ask for them, and the
    first ones after the walk's end.  ``told`` has the others with their status.
    """

    def __init__(self, r: Request):
        self.r, self.n = r, 0
        self.rows: dict[int, Row] = {}
        self.told: list[tuple[Row, str]] = []
        self.taken: list[int] = []
        self.past: list[int] = []
        self.status: dict[int, str] = {}
        self.passed: list[tuple[int, Row]] = []
        self.n_passed, self.first_passed = 0, None
        self.below: Row | None = None
        self.stopped, self.reached, self.coin_taken = "exhausted", 0, 0
        self.ended, self.following = False, []
        self.artists: list[str] = []
        self.seen: dict[str, set] = {}
        self.seed_song = None

    def _take(self, i: int, x: Row, past: bool = False) -> bool:
        near = self.artists[-self.r.spacing :] if self.r.spacing else self.artists
        if x.twin is not None and x.twin in self.seen["twin"]:
            status = "duplicate"
        elif x.artist and x.artist in near:
            status = "artist"
        elif x.recording is not None and x.recording in self.seen["recording"]:
            status = "recording"
        else:
            self.seen["twin"].add(x.twin)
            self.seen["recording"].add(x.recording)
            self.taken.append(i)
            self.rows[i] = x
            self.artists.append(x.artist)
            self.status[i] = "kept"
            if past:
                self.past.append(i)
            return True
        self.told.append((x, status))
        return False

    def _passed_over(self, x: Row) -> None:
        self.first_passed = self.first_passed or x
        self.told.append((x, "variety"))

    def _take_passed(self, floor: int | None) -> None:
        """Those that the coin passed over, up to the floor; after that none of them is asked for again."""
        for j, x in self.passed:
            if floor is not None and len(self.taken) < floor:
                took = self._take(j, x)
                self.coin_taken += took
                if not took:
                    self.first_passed = self.first_passed or x
            else:
                self._passed_over(x)
        self.passed = []

    def feed(self, x: Row) -> None:
        i, r, floor = self.n, self.r, self.r.walk_floor
        self.n += 1
        if not i:
            self.seen, self.seed_song = {"twin": {x.seed_twin} - {None}, "recording": {x.seed_recording} - {None}}, x.seed_song
        if not self.ended:
            past = r.line is not None and x.fit < r.line
            if past:
                if self.below is None:
                    self.below, self.stopped = x, "fit"
                    self._take_passed(floor)
                self.ended = floor is None or len(self.taken) >= floor
            if not self.ended:
                self.reached += 1
                if not past and r.thin > 0 and x.toss >= 1.0 / (1.0 + r.thin):
                    self.n_passed += 1
                    if floor is None:
                        self._passed_over(x)
                    else:
                        self.passed.append((i, x))
                elif self._take(i, x, past):
                    if past:
                        self.ended = len(self.taken) >= floor
                    if len(self.taken) >= r.wanted and not self.ended:
                        self.stopped, self.ended = "size", True
                return
        if len(self.following) < NEXT:
            self.following.append(x)

    def end(self) -> None:
        """No more candidates."""
        self._take_passed(None)


def route(walk: Walk) -> list[int]:
    """The list that a request gets of its walk; sets the status of what the walk took and the list leaves out."""
    r, rows, status = walk.r, walk.rows, walk.status
    past = set(walk.past)
    for i in walk.taken:
        status[i] = "carried" if i in past else "count"
    artists = {a.strip().lower() for a in r.banned_artists}

    def allowed(i: int) -> bool:
        if rows[i].id in r.bans:
            status[i] = "removed"
        elif artists and (rows[i].artist or "").strip().lower() in artists:
            status[i] = "blocked"
        else:
            return True
        return False

    seen = {walk.seed_song}

    def new(i: int) -> bool:
        if not r.dedup:
            return True
        if rows[i].song in seen:
            status[i] = "duplicate"
            return False
        seen.add(rows[i].song)
        return True

    picks = [i for i in walk.taken if i not in past and allowed(i) and new(i)]
    if r.variety:
        order = spread_of(np.linspace(1.0, 0.0, len(picks)), _vectors(rows, picks), r.size, VARIETY_BALANCE)
        chosen = [picks[k] for k in order]
        status.update({i: "near-twin" for i in set(picks) - set(chosen)})
        picks = chosen
    else:
        picks = picks[: r.size]
    if r.flow and picks:
        picks = [picks[k] for k in flow_of(_vectors(rows, picks), [rows[i].id for i in picks])]
    # what was carried past the line is a tail, used only where too few others are left
    for i in walk.past if r.floor else ():
        if len(picks) >= r.floor:
            break
        if allowed(i) and new(i):
            picks.append(i)
    status.update({i: "kept-past" if i in past else "kept" for i in picks})
    return picks


def _vectors(rows: dict[int, Row], at: Iterable[int]) -> np.ndarray:
    return np.array([rows[i].vector for i in at], dtype=np.float64)


def stop_reason(walk: Walk, returned: int, carried: int) -> str:
    """Why a list has the length it has."""
    r, stopped = walk.r, walk.stopped
    if r.line is None:
        return "quota"
    if carried:
        return "floor"
    if returned >= r.size:
        return "size"
    if not returned:
        return "thinned" if walk.n_passed else "none_fit" if stopped == "fit" else "empty"
    return {"fit": "fit", "size": "trimmed"}.get(stopped, "exhausted")


FIELD = "request int, id long, rank int, score double, fit double, status string, position int"
STOP = "reason string, stopped string, requested int, returned int, walked int, reached int, fitting int, passed_over int, taken_back int, carried int, weakest_id long, weakest_fit double, left_id long, left_fit double, left_for string, whole boolean"


NAMES, STOP_NAMES = ([c.split()[0] for c in schema.split(", ")] for schema in (FIELD, STOP))


def _told(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES).astype(object).reindex(columns=[*NAMES, *STOP_NAMES]).astype(object)


def _seen(walk: Walk) -> pd.DataFrame:
    """What became of the candidates so far that the walk holds no longer."""
    out = _told([(walk.r.number, x.id, x.rank, x.score, x.fit, status, None) for x, status in walk.told])
    walk.told = []
    return out


def _answer(walk: Walk) -> pd.DataFrame:
    """The rest of a request's field, and its summary."""
    walk.end()
    r, rows, picks, nearest = walk.r, walk.rows, route(walk), walk.following
    carried = [i for i in picks if i in set(walk.past)]
    fits = [i for i in walk.taken if i not in picks and walk.status[i] in ("count", "near-twin", "carried")]
    strongest, left_for = (nearest[0], "count" if walk.stopped == "size" else "line") if nearest else (None, "line")
    if walk.below is not None and not walk.past:
        strongest = walk.below
    if strongest is not None and r.line is not None and strongest.fit < r.line:
        left_for = "line"
    if fits:
        strongest, left_for = rows[max(fits, key=lambda i: (rows[i].fit, -i))], "count"
    if walk.first_passed is not None:
        strongest = walk.first_passed
    weakest = rows[min(picks, key=lambda i: rows[i].fit)] if picks else None
    place = {i: k for k, i in enumerate(picks, 1)}
    field = _told([(r.number, *rows[i][:4], walk.status[i], place.get(i)) for i in walk.taken] + [(r.number, *x[:4], "next", None) for x in nearest])
    of = lambda x, c: None if x is None else getattr(x, c)
    fitting = sum(rows[i].fit >= r.line for i in walk.taken) if r.line is not None else None
    stop = (
        stop_reason(walk, len(picks), len(carried)), walk.stopped, r.size, len(picks), len(walk.taken), walk.reached, fitting, walk.n_passed, walk.coin_taken, len(carried),
        of(weakest, "id"), of(weakest, "fit"), of(strongest, "id"), of(strongest, "fit"), left_for,
        # a longer head could change nothing
        walk.stopped != "exhausted" and len(nearest) >= NEXT,
    )
    summary = pd.DataFrame([(r.number, *stop)], columns=["request", *STOP_NAMES]).astype(object)
    return pd.concat([_seen(walk), field, summary], ignore_index=True)[[*NAMES, *STOP_NAMES]]


def walked(batches: Iterable[pd.DataFrame], requests: dict[int, Request]) -> Iterator[pd.DataFrame]:
    """The answers of requests whose candidates come one request after the other, by rank."""
    walk: Walk | None = None
    for batch in batches:
        for number, *values in zip(batch["request"], *(batch[c] for c in ROW), strict=True):
            if walk is None or walk.r.number != number:
                if walk is not None:
                    yield _answer(walk)
                walk = Walk(requests[int(number)])
            walk.feed(Row(*values))
        if walk is not None and walk.told:
            yield _seen(walk)
    if walk is not None:
        yield _answer(walk)


def answers(pool: DataFrame, requests: list[Request], first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``field``, what became of each candidate that a walk reached and of the ten after them, and ``stops``, a row for each request.

    ``pool`` has ``id``, ``artist``, ``vector``, ``twin``, ``recording`` and ``song``, and
    the boolean columns that requests name.  The score is the dot product, and the fit
    its share of the seed's own.  A request whose seed is not in the pool has no rows; one
    that finds no candidate at all has only a row in ``stops``.
    """
    spark, by_number = pool.sparkSession, {r.number: r for r in requests}
    asked = spark.createDataFrame([(r.number, r.seed, r.mask) for r in requests], "request int, seed long, mask string")
    masks = sorted({r.mask for r in requests if r.mask})
    rows = pool.withColumn("vector", vectors.doubles(F.col("vector")))
    seeds = asked.join(rows.select(F.col("id").alias("seed"), *[F.col(c).alias(f"seed_{c}") for c in ("vector", "twin", "recording", "song")]), "seed")
    # the seeds are the requests' own few rows
    pairs = rows.crossJoin(F.broadcast(seeds)).where("id <> seed")
    for m in masks:
        pairs = pairs.where((F.col("mask").isNull()) | (F.col("mask") != m) | F.coalesce(m, F.lit(False)))
    score = F.round(vectors.dot(F.col("vector"), F.col("seed_vector")), 9)
    own = vectors.dot(F.col("seed_vector"), F.col("seed_vector"))
    scored = pairs.withColumn("score", score).withColumn("fit", F.col("score") / F.when(own > 1e-9, own).otherwise(1.0)).withColumn("toss", text.hash_unit(F.lit("coin"), F.col("seed"), F.col("id")))
    order = Window.partitionBy("request").orderBy(F.desc("score"), "id")
    sizes = {r["request"]: r["n"] for r in scored.groupBy("request").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = first or max((r.wanted * (r.spacing + 1) * 2 + NEXT for r in requests), default=1)

    # vectors go along only where a route compares them
    compared = [r.number for r in requests if r.variety or r.flow]
    scored = scored.withColumn("vector", F.when(F.col("request").isin(compared), F.col("vector")))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return walked(batches, by_number)

    open_requests, out = sorted(sizes), None
    while True:
        mine = scored.where(F.col("request").isin(open_requests))
        head = mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("request", *ROW)
        # by rank within a request, so that a walk sees its candidates one after the other and holds few of them
        told = kept(head.repartition("request").sortWithinPartitions("request", "rank").mapInPandas(fold, f"{FIELD}, {STOP}"), "mix")
        whole = {r["request"] for r in told.where("whole").select("request").collect()}
        ended = [r for r in open_requests if sizes[r] <= limit or r in whole]
        answered = told.where(F.col("request").isin(ended))
        out = answered if out is None else out.unionByName(answered)
        open_requests = [r for r in open_requests if r not in ended]
        if not open_requests:
            break
        limit *= 4
    stops = out.where("reason IS NOT NULL").select("request", *STOP_NAMES).drop("whole")
    none = seeds.where(~F.col("request").isin(list(sizes))).select("request")
    pools = spark.createDataFrame(list(sizes.items()), "request int, pool long")
    empty = none.select("request", F.lit("empty").alias("reason"), F.lit("exhausted").alias("stopped")).withColumn("pool", F.lit(0).cast("long"))
    stops = stops.join(pools, "request").unionByName(empty, allowMissingColumns=True)
    return out.where("id IS NOT NULL").select(*NAMES), stops


def delivered(field: DataFrame) -> DataFrame:
    return field.where("position IS NOT NULL").select("request", "position", "id", "rank", "score", "fit", "status")


def left_out(field: DataFrame) -> DataFrame:
    """The strongest that a list left out, at most 40 a request: best fit first."""
    order = Window.partitionBy("request").orderBy(F.desc("fit"), "rank")
    return field.where("position IS NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_LEFT)


def trace_field(field: DataFrame) -> DataFrame:
    """What became of the candidates in order of rank, at most 600 a request: a walk that reaches further is cut at its least fitting end."""
    order = Window.partitionBy("request").orderBy("rank")
    return field.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_FIELD).drop("place")


def trace_counts(field: DataFrame) -> DataFrame:
    return field.groupBy("request", "status").agg(F.count(F.lit(1)).alias("n"))


#: The stage that decided where a list ended, by reason.
DECIDERS = {"size": "result", "quota": "result", "fit": "line", "floor": "line", "none_fit": "line", "thinned": "walk", "exhausted": "pool", "trimmed": "after", "empty": "pool"}


def trace_stages(stops: DataFrame) -> DataFrame:
    """The stages of each request in order, with what each left and whether it decided the list's end."""
    decider = F.coalesce(*[F.when(F.col("reason") == k, F.lit(v)) for k, v in DECIDERS.items()])
    n = {"pool": "pool", "walk": "reached", "line": "fitting", "after": "returned", "result": "returned"}
    stages = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(name).alias("stage"), F.col(c).cast("long").alias("n")) for k, (name, c) in enumerate(n.items(), 1)])
    return stops.select("request", decider.alias("decider"), F.explode(stages).alias("s")).select("request", "s.*", (F.col("s.stage") == F.col("decider")).alias("decides"))
