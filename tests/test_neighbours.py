"""Neighbours by cells against all pairs, and how many blocks are compared."""

from __future__ import annotations

import numpy as np
import pytest

from quaverlake.operators import scoring

SCHEMA = "id long, vector array<double>"


def clustered(seed, groups=12, each=40, spread=0.02, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), each, axis=0) + spread * rng.normal(size=(groups * each, d))
    return x * rng.choice([1.0, 1.0, 0.5], size=(len(x), 1))


def table(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], SCHEMA)


@pytest.mark.parametrize("block", [10, 64, 2048])
def test_same_as_all_pairs(spark, block):
    x = np.concatenate([clustered(1, 6, 25), np.zeros((2, 16)), np.repeat(clustered(2, 1, 1), 30, axis=0)])
    s = np.round(x @ x.T, 9)
    pairs = {(int(a), int(b)) for a, b in zip(*np.nonzero(s >= 0.8), strict=True) if a < b}
    found = scoring.similar_pairs(table(spark, x), 0.8, block).collect()
    assert {(r.a, r.b) for r in found} == pairs
    assert len(found) == len(pairs)
    np.fill_diagonal(s, -np.inf)
    got = {}
    for r in scoring.nearest(table(spark, x), 5, block).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == {i: sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:5] for i in range(len(x))}


def test_blocks_are_skipped_on_clustered_rows(spark):
    cells = scoring.Cells(table(spark, clustered(3)), 24)
    every = len(cells.cells) ** 2
    assert (cells.most >= 0.9).sum() < every / 2
    dealt = cells.pairs(cells.most >= 0.9, False).select("one", "two").distinct().count()
    assert dealt < sum(cells.parts.values()) ** 2 * 0.6


def test_empty_and_small_pools(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert scoring.similar_pairs(none, 0.5).count() == 0
    assert scoring.nearest(none, 3).count() == 0
    assert scoring.nearest(table(spark, np.eye(2)), 3).count() == 2


def test_rows_travel_to_as_many_blocks_at_any_size(spark, monkeypatch):
    """Where nothing is ruled out, a pool of four times the rows deals about four times as many, not sixteen."""
    monkeypatch.setattr(scoring, "LEAST_BLOCK", 8)
    rng, dealt = np.random.default_rng(4), []
    for n in (400, 1600):
        cells = scoring.Cells(table(spark, rng.normal(size=(n, 16))))
        dealt.append(cells.pairs(np.full(cells.most.shape, True), False).count())
    assert dealt[1] < 6 * dealt[0]


def test_best_of_rows_with_many_equals():
    rng = np.random.default_rng(5)
    s = np.round(rng.normal(size=(40, 90)), 1)
    s[7] = 0.5
    own = np.eye(40, 90, dtype=bool)
    masked = np.where(own, -np.inf, s)
    want = {(r, int(c)) for r in range(40) for c in np.lexsort((np.arange(90), -masked[r]))[:6]}
    exact = np.sort(masked, axis=1)[:, -6]
    for sure in (np.full(40, -np.inf), exact, exact - 0.2):
        i, j, v = scoring.best_of(s, own, 6, sure)
        assert want <= set(zip(i.tolist(), j.tolist(), strict=True))
        assert len(i) <= 40 * 24
        assert (v == masked[i, j]).all()
