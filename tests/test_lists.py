"""Queries without SQL against plain versions over the whole pool."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF

from quaverlake import registry

SEEDS = [0, 7, 42]


@pytest.fixture(scope="module")
def rows():
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    return t["vec_id"], [str(x) for x in t["label"]], np.array(t["embedding"], dtype=np.float64)


def ranking(ids, x, seed):
    q = x[ids.index(seed)]
    scored = [(-round(float((v * q).sum()), 9), i) for i, v in zip(ids, x, strict=True) if i != seed]
    return [(i, -s) for s, i in sorted(scored)]


def unit(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def test_walk_reports(spark, rows):
    ids, artists, x = rows
    got = {(r.seed_id, r.id): (r["rank"], r.position, r.status) for r in registry.queries()["walk_reports"](spark, SF).collect()}
    assert len(got) == 3 * (len(ids) - 1)
    for seed in SEEDS:
        out, ended = [], False
        for place, (i, score) in enumerate(ranking(ids, x, seed), 1):
            status, position = "left", None
            if not ended:
                below, artist = score < 0.25, artists[ids.index(i)]
                if below and len(out) >= 10:
                    status, ended = "fit", True
                elif artist in out[-3:]:
                    status = "artist"
                else:
                    out.append(artist)
                    status, position = "past" if below else "taken", len(out)
                ended = ended or len(out) >= 20 or below and len(out) >= 10
            assert got[seed, i] == (place, position, status), (seed, i)


def test_radio_wave(spark, rows):
    ids, artists, x = rows
    got = {(r.seed_id, r.position): r.id for r in registry.queries()["radio_wave"](spark, SF).collect()}
    want = {}
    for seed in SEEDS:
        taken = []
        for i, _ in ranking(ids, x, seed):
            k = ids.index(i)
            z = (x[k][0] - math.sin(2 * math.pi * (len(taken) % 20) / 20)) / 0.35
            artist_near = artists[k] in [artists[ids.index(j)] for j in taken[-3:]]
            if len(taken) < 20 and unit("radio", seed, i) < 1 / 1.5 and unit("energy", seed, i) < math.exp(-z * z / 2) and not artist_near:
                taken.append(i)
        want |= {(seed, n): i for n, i in enumerate(taken, 1)}
    assert got == want


def test_adventure_path(spark, rows):
    ids, artists, x = rows
    got = [r.id for r in registry.queries()["adventure_path"](spark, SF).orderBy("position").collect()]
    a, b = x[ids.index(0)], x[ids.index(42)]
    path, recent = [0], [artists[ids.index(0)]]
    for t in np.linspace(0, 1, 12)[1:-1]:
        p = (1 - t) * a + t * b
        p /= np.linalg.norm(p)
        free = sorted((-round(float((v * p).sum()), 9), i) for i, v in zip(ids, x, strict=True) if i not in (*path, 42))[:4]
        pick = next((i for _, i in free if artists[ids.index(i)] not in recent[-3:]), free[0][1])
        path.append(pick)
        recent.append(artists[ids.index(pick)])
    assert got == [*path, 42]


def test_all_but_the_top(spark, rows):
    ids, _, x = rows
    c = x - x.mean(axis=0)
    top = np.linalg.eigh(c.T @ c)[1][:, -2:]
    y = c - (c @ top) @ top.T
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    got = {(r.seed_id, r["rank"]): r.score for r in registry.queries()["all_but_the_top"](spark, SF).collect()}
    assert len(got) == 3 * 40
    for seed in SEEDS:
        best = sorted((-float(y[k] @ y[ids.index(seed)]) for k, i in enumerate(ids) if i != seed))[:40]
        assert np.allclose([got[seed, n] for n in range(1, 41)], -np.array(best), atol=1e-6)


def test_draws_follow_the_weights(spark):
    """The first draw of many mixes is each row as often as its weight says."""
    from pyspark.sql import functions as F

    from quaverlake.operators import lists

    rows = spark.range(4000).selectExpr("id AS draw").crossJoin(spark.range(1, 17).selectExpr("id", "cast(id AS int) AS rank", "cast(id AS string) AS artist", "-cast(id AS double) AS score"))
    ranking = rows.withColumns({"seed_id": F.lit(0), "variety": F.lit(9)})
    first = lists.sampled_mix(ranking, 2, 3).where("position = 1").groupBy("rank").count().collect()
    weights = np.exp(-np.arange(16) / 33.0)
    want = 4000 * weights / weights.sum()
    got = np.zeros(16)
    for r in first:
        got[r["rank"] - 1] = r["count"]
    assert ((got - want) ** 2 / want).sum() < 37.7  # chi square, 15 degrees, one in a thousand


def test_sampled_mix_fills_up_rather_than_ends_short(spark):
    from quaverlake.operators import lists

    ranking = spark.createDataFrame([(0, k, "same", -float(k), k, 1, v) for k in range(1, 9) for v in (0, 9)], "seed_id long, id long, artist string, score double, rank int, draw int, variety int")
    got = lists.sampled_mix(ranking, 5, 3)
    assert got.where("variety = 9").count() == 5
    assert got.where("variety = 0").count() == 1
    free = lists.sampled_mix(ranking, 5, 0)
    assert free.where("variety = 0").count() == 5


def test_sampled_mix_without_variety_looks_as_far_as_it_must(spark):
    """Many copies of one artist come first: the list is filled from what lies behind them."""
    from quaverlake.operators import lists

    rows = [(0, k, "same" if k <= 600 else f"a{k}", -float(k), k, 1, v) for k in range(1, 641) for v in (0, 9)]
    ranking = spark.createDataFrame(rows, "seed_id long, id long, artist string, score double, rank int, draw int, variety int")
    got = lists.sampled_mix(ranking, 5, 3).where("variety = 0").orderBy("position").collect()
    assert [r["rank"] for r in got] == [1, 601, 602, 603, 604]


def test_label_pairs_are_bounded(spark):
    from pyspark.sql import functions as F

    from quaverlake.operators import evaluation

    rows = [(k, "Big", f"album {k % 900}") for k in range(2500)] + [(9000 + k, "Small", "One") for k in range(30)] + [(9900, "Lone", "x"), (9901, None, "x"), (9902, " ", "x")]
    df = spark.createDataFrame(rows, "id long, artist string, album string")
    pairs = evaluation.label_pairs(df, F.lit(False)).collect()
    of = {}
    for r in pairs:
        of.setdefault((r.kind, r.id), set()).add(r.mate)
    assert len(pairs) == sum(map(len, of.values()))
    assert all(len(m) == 20 and i not in m for (kind, i), m in of.items() if kind == "artist")
    assert {i for kind, i in of if kind == "artist"} == {*range(2500), *range(9000, 9030)}
    assert {len(m) for (kind, _), m in of.items() if kind == "album"} <= {1, 2}
    assert not any(i >= 9000 for kind, i in of if kind == "album")


def test_key_compatibility_of_all_keys(spark):
    """The full table of 24 keys: symmetric, 1 on the diagonal, and as many of each value as the circle of fifths has."""
    from pyspark.sql import functions as F

    from quaverlake.functions import text

    keys = spark.range(24)
    half = lambda c: F.floor(F.col(c) / 2)
    pairs = keys.selectExpr("id AS a").crossJoin(keys.selectExpr("id AS b"))
    fit = text.key_compatibility(half("a"), F.col("a") % 2 == 0, half("b"), F.col("b") % 2 == 0)
    got = {(r.a, r.b): r.fit for r in pairs.select("a", "b", fit.alias("fit")).collect()}
    assert all(got[a, b] == got[b, a] for a, b in got)
    assert all(got[k, k] == 1.0 for k in range(24))
    assert sorted(got[0, b] for b in range(24)) == sorted([1.0, 0.8, 0.8, 0.8, 0.4, 0.4] + [0.0] * 18)


def test_sync_deals_lines_before_grouping(spark, monkeypatch):
    """Tasks that make lines distinct grow in number with the lines, however few files hold them."""
    from conftest import SF

    from quaverlake.plans import exports as plans

    want = sorted(map(tuple, plans.playlist_sync(spark, SF).collect()))
    monkeypatch.setattr(plans, "ROWS", 700, raising=False)
    found = plans.playlist_sync(spark, SF)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert f"{-(-n // 700)}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == want
