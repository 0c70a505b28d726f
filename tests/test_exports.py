"""Names of copies: distinct and safe, made once an item."""

from __future__ import annotations

import pytest
from conftest import SF

from quaverlake import registry
from quaverlake.operators import exports


@pytest.mark.parametrize("name", ["copy_plan", "copy_plan_tree"])
def test_one_sort_by_list(spark, name):
    """What a part's name is made of is made below the join, and nothing is numbered a second time by its name."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "regexp_extract" in below
    assert "regexp_extract" not in above
    assert "lower(" not in plan
    assert above.count("row_number()") == 1


@pytest.mark.parametrize("tree", [False, True])
def test_equal_titles_have_distinct_names(spark, tree):
    titles = ["con", "CON", "con.", "a/b", "a:b", "", None, "x" * 130, "x" * 130, "1 con"] * 11
    rows = [(n % 2, n // 2, f"r/{n}.mp3", t, "A", "B") for n, t in enumerate(titles)] + [(None, 1, "r/y.mp3", "y", None, None)]
    items = spark.createDataFrame(rows, "playlist long, position long, path string, title string, artist string, album string").repartition(4)
    got = exports.copy_plan(exports.copy_names(items, tree), tree).collect()
    assert len(got) == len(rows)
    assert len({(r.playlist, r.name.lower()) for r in got}) == len(rows)
    names = {(r.playlist, r.ordinal): r.name for r in got}
    assert names[0, 1] == ("A/B/01 con.mp3" if tree else "01 A - con.mp3")
    assert names[1, 55] == ("A/B/55 1 con.mp3" if tree else "55 A - 1 con.mp3")
    assert names[None, 1] == ("Unknown Artist/Unknown Album/01 y.mp3" if tree else "01 y.mp3")
