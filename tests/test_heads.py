"""Walks over a ranking's head give what they give over all of it, and no task gets more than the head."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaverlake.operators import lists


@pytest.fixture(scope="module")
def ranking(spark):
    rng = np.random.default_rng(1)
    rows = [(s, k, f"a{int(rng.integers(0, 9))}", float(x), float(rng.uniform(-1, 1))) for s in (0, 7) for k, x in enumerate(rng.uniform(0, 1, 600))]
    return lists.ranked(spark.createDataFrame(rows, "seed_id long, id long, artist string, score double, energy double")).cache()


@pytest.mark.parametrize("build", [
    lambda r, first: lists.radio(r, 20, 3, 0.5, first=first),
    lambda r, first: lists.radio(r, 20, 3, 0.5, "wave", energy="energy", first=first),
    lambda r, first: lists.walk_report(r, 20, 3, line=0.25, floor=10, ceiling={7: 0.9}, first=first),
    lambda r, first: lists.walk_report(r, 20, 3, line=0.99, floor=30, variety=0.5, first=first),
])
def test_a_head_gives_what_the_pool_gives(ranking, build):
    whole = sorted(map(str, build(ranking, 600).collect()))
    assert whole and all(sorted(map(str, build(ranking, first).collect())) == whole for first in (4, 100))


def test_rows_past_the_head_reach_no_walk(ranking):
    """The artist of a row past the head raises an error where a walk reads it."""
    seen = ranking.withColumn("artist", F.when(F.col("rank") > 400, F.raise_error(F.lit("past the head")).cast("string")).otherwise(F.col("artist")))
    assert lists.radio(seen, 20, 3, 0.5).count() == 40
