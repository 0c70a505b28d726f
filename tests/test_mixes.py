"""Mix requests against a plain walk and route, over a pool held in memory."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from conftest import SF

from quaverlake.operators import mixes
from quaverlake.operators.mixes import Request
from quaverlake.plans.mixes import FULL, PLAIN, song_pool


@pytest.fixture(scope="module")
def songs(spark):
    return [r.asDict() for r in song_pool(spark, SF).collect()]


@pytest.fixture(scope="module")
def found(spark):
    field, stops = mixes.answers(song_pool(spark, SF), PLAIN + FULL, first=30)
    return [r.asDict() for r in field.collect()], {r.request: r for r in stops.collect()}


def unit(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def plain_ranking(songs, r):
    seed = next(s for s in songs if s["id"] == r.seed)
    q = np.array(seed["vector"])
    rows = [s | {"score": round(float((np.array(s["vector"]) * q).sum()), 9)} for s in songs if s["id"] != r.seed and (r.mask is None or s[r.mask])]
    rows.sort(key=lambda s: (-s["score"], s["id"]))
    return seed, [s | {"fit": s["score"] / float((q * q).sum())} for s in rows]


def plain_mix(songs, r):
    """Ids of the list, and of those past the line, by a straight reading of the rules."""
    seed, rows = plain_ranking(songs, r)
    floor = None if r.line is None or not r.floor_share else max(1, int(np.ceil(r.size * r.floor_share)))
    want = 200 if r.variety else min(r.size * 4, 200) if r.dedup else r.size
    if r.bans or r.banned_artists:
        want = min(max(want * 3, want + 60), 400)
    walk_floor = floor if floor is None or want <= r.size else min(want, floor + want - r.size)
    twins, recs = {seed["twin"]} - {None}, {seed["recording"]} - {None}
    out, passed, past = [], [], []

    def take(s):
        near = [x["artist"] for x in out][-r.spacing :] if r.spacing else [x["artist"] for x in out]
        if s["twin"] in twins or (s["artist"] and s["artist"] in near) or s["recording"] in recs:
            return False
        if s["twin"] is not None:
            twins.add(s["twin"])
        if s["recording"] is not None:
            recs.add(s["recording"])
        out.append(s)
        return True

    below = False
    for s in rows:
        if r.line is not None and s["fit"] < r.line:
            if not below and walk_floor is not None:
                for p in passed:
                    if len(out) >= walk_floor:
                        break
                    take(p)
            below = True
            if walk_floor is None or len(out) >= walk_floor:
                break
        elif r.thin and unit("coin", r.seed, s["id"]) >= 1 / (1 + r.thin):
            passed.append(s)
            continue
        if take(s):
            if below:
                past.append(s)
                if len(out) >= walk_floor:
                    break
            if len(out) >= want:
                break
    blocked = {a.strip().lower() for a in r.banned_artists}
    ok = lambda s: s["id"] not in r.bans and s["artist"].lower() not in blocked
    seen, picks = {seed["song"]}, []
    for s in out:
        if s in past or not ok(s) or (r.dedup and s["song"] in seen):
            continue
        seen.add(s["song"])
        picks.append(s)
    if r.variety and picks:
        rel, x = np.linspace(1, 0, len(picks)), np.array([p["vector"] for p in picks])
        chosen = [0]
        while len(chosen) < min(r.size, len(picks)):
            score = [(round(0.3 * rel[k] - 0.7 * max(round(float(x[k] @ x[c]), 9) for c in chosen), 9), -k) for k in range(len(picks)) if k not in chosen]
            chosen.append(-max(score)[1])
        picks = [picks[k] for k in chosen]
    picks = picks[: r.size]
    if r.flow and picks:
        path, left = [picks[0]], picks[1:]
        while left:
            nearest = max(left, key=lambda s: (round(float(np.dot(s["vector"], path[-1]["vector"])), 9), -s["id"]))
            path.append(nearest)
            left = [s for s in left if s["id"] != nearest["id"]]
        picks = path
    for s in past if floor else []:
        if len(picks) >= floor:
            break
        if ok(s) and not (r.dedup and s["song"] in seen):
            seen.add(s["song"])
            picks.append(s)
    return [s["id"] for s in picks], {s["id"] for s in past}


@pytest.mark.parametrize("r", PLAIN + FULL, ids=lambda r: str(r.number))
def test_lists(songs, found, r):
    field, stops = found
    want, past = plain_mix(songs, r)
    rows = sorted((f["position"], f["id"], f["status"]) for f in field if f["request"] == r.number and f["position"])
    assert [i for _, i, _ in rows] == want
    assert {i for _, i, s in rows if s == "kept-past"} == past & set(want)
    assert stops[r.number].returned == len(want)


def test_seeds_twin_never_comes(songs, found):
    twin = {s["id"]: s["twin"] for s in songs}
    seeds = {r.number: r.seed for r in PLAIN + FULL}
    kept = [f for f in found[0] if f["position"]]
    assert kept
    assert not [f for f in kept if twin[f["id"]] is not None and twin[f["id"]] == twin[seeds[f["request"]]]]
    assert any(f["status"] == "duplicate" for f in found[0])


def test_trace_adds_up(spark, songs, found):
    """Each candidate has one status; those reached are all of the ranking down to the last, and the stages shrink."""
    for r in PLAIN + FULL:
        rows = [f for f in found[0] if f["request"] == r.number]
        assert len({f["id"] for f in rows}) == len(rows)
        reached = sorted(f["rank"] for f in rows if f["status"] != "next")
        assert len(reached) == found[1][r.number].reached
        assert sum(f["status"] == "next" for f in rows) <= 10
        if r.line is None:
            assert reached == list(range(1, len(reached) + 1))
        assert found[1][r.number].pool >= len(reached) >= found[1][r.number].walked


def test_reasons(found):
    reasons = {k: s.reason for k, s in found[1].items()}
    assert reasons[1] == "quota"
    assert reasons[5] == "none_fit"
    assert {reasons[k] for k in (11, 14)} <= {"floor", "size"}
    assert set(reasons) == {r.number for r in PLAIN + FULL}


SCHEMA = "id long, artist string, vector array<double>, twin string, recording string, song string, some boolean"


def test_odd_pools(spark):
    rows = [(0, None, [1.0, 0.0], None, None, None, True), (1, None, [0.9, 0.1], None, None, None, False), (2, "a", [0.8, 0.2], "t", "r", "s", None), (3, "a", [0.8, 0.2], "t", "r", "s", True)]
    pool = spark.createDataFrame(rows, SCHEMA)
    asks = [Request(1, 0, 3, 0), Request(2, 0, 3, mask="some"), Request(3, 99), Request(4, 0, 3, line=0.5, thin=1e9, floor_share=0.0), Request(5, 0, 2, line=0.99)]
    field, stops = mixes.answers(pool, asks)
    lists = {}
    for f in field.where("position IS NOT NULL").orderBy("request", "position").collect():
        lists.setdefault(f.request, []).append(f.id)
    assert lists == {1: [1, 2], 2: [3], 5: [1]}
    assert {s.request: s.reason for s in stops.collect()} == {1: "quota", 2: "quota", 4: "thinned", 5: "floor"}
    alone, stops = mixes.answers(pool.where("id = 0"), [Request(1, 0)])
    assert alone.count() == 0
    assert [(s.reason, s.pool) for s in stops.collect()] == [("empty", 0)]


def test_long_walks_hold_little():
    """A walk past very many copies of one song holds what it took, and tells each candidate's status."""
    import tracemalloc

    import pandas as pd

    def batches():
        for k in range(60):
            ids = np.arange(k * 5000, k * 5000 + 5000)
            rows = {"request": 1, "id": ids, "rank": ids + 1, "score": 1.0 - ids * 1e-9, "fit": 1.0 - ids * 1e-9, "toss": 0.0, "artist": "a", "twin": np.where(ids % 100_000 == 0, ids.astype(str), "t")}
            yield pd.DataFrame(rows | {c: None for c in ("recording", "song", "vector", "seed_twin", "seed_recording", "seed_song")})

    tracemalloc.start()
    n, last = {}, None
    for told in mixes.walked(batches(), {1: Request(1, 0, 20, 1)}):
        for status, m in told["status"].value_counts().items():
            n[status] = n.get(status, 0) + m
        last = told
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert n["kept"] >= 1
    assert sum(n.values()) == 300_000
    assert last["reached"].dropna().tolist() == [300_000]
    assert peak < 30
