"""Settings in their order, and percentiles by ranges against a plain average of ties."""

from __future__ import annotations

import random

import pytest

from quaverlake.operators import profiles, ranks


def test_order_of_settings():
    assert profiles.settings().profile == "v2"
    assert profiles.settings(trained=True, has_head=True).profile == "sound"
    assert profiles.settings(trained=True).profile == "v2"
    sound = profiles.settings("sound")
    assert (sound.fusion, sound.space, sound.weights["era"]) == ("z", "head", 1.5)
    saved = {"profile": "sound", "best_weights": {"era": 2.0}, "scoring": {"fusion": "rank", "family_credit": 7}}
    assert profiles.settings(saved=saved).weights["era"] == 0.1  # written for another profile
    mixed = profiles.settings("sound", saved=saved, weights={"genre": 0.9})
    assert (mixed.weights["era"], mixed.weights["genre"], mixed.fusion, mixed.family_credit) == (2.0, 0.9, "rank", 0.0)
    for bad in ({"profile": "x"}, {"profile": "musicip"}, {"fusion": "x"}, {"family_credit": 2}):
        with pytest.raises(ValueError):
            profiles.settings(**bad)


def test_overrides_are_clamped_and_leave_the_base():
    base = profiles.settings()
    moved = profiles.overridden(base, {"clap": "7", "era": "-1", "genre": "x", "key": "3", "loud": "0.5"})
    assert (moved.weights["clap"], moved.weights["era"], moved.weights["genre"], moved.weights["key"], moved.weights["loud"]) == (5.0, 0.0, 0.3, 0.0, 0.5)
    assert base.weights["clap"] == 1.0
    assert "era" not in moved.active


def test_percentiles(spark):
    rng = random.Random(2)
    rows = [(g, k, rng.choice([None, 1.0, 2.0, 2.5, -3.0, rng.random()]), 5.0) for g in range(3) for k in range(200)] + [(9, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "seed_id long, id long, x double, same double").repartition(5)
    got = {(r.seed_id, r.id): (r.x, r.same) for r in ranks.percentiles(df, ["x", "same"]).collect()}
    for g, k, x, _ in rows:
        others = [v for h, _, v, _ in rows if h == g and v is not None]
        want = None if x is None else 0.5 if len(others) < 2 else (sum(v < x for v in others) + (others.count(x) - 1) / 2) / (len(others) - 1)
        assert got[g, k][0] == (want if want is None else pytest.approx(want))
        assert got[g, k][1] == pytest.approx(0.5)


def test_no_window_over_a_pool(spark):
    """Sums run within ranges; the only window beside them is over the ranges' totals."""
    df = spark.range(1000).selectExpr("0L AS seed_id", "id", "cast(id % 37 AS double) AS x")
    plan = ranks.percentiles(df, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.strip(" +-:|").startswith("Window")]
    assert windows
    assert all("range" in line or "total" in line for line in windows)
