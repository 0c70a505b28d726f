"""Connected components: a small graph in one task and a larger one by contractions, against a plain search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaverlake.llm import graph


def plain_roots(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = {}
    for start in sorted(near):
        todo = [start] if start not in found else []
        while todo:
            node = todo.pop()
            if node not in found:
                found[node] = start
                todo += near[node]
    return found


def graphs():
    rng = np.random.default_rng(3)
    wide = rng.integers(-(2**63), 2**63 - 1, 60)
    star = [(500, k) for k in range(501, 560)] + [(k, 499) for k in range(480, 490)]
    places = rng.permutation(70) + 1000
    path = [(int(x), int(y)) for x, y in zip(places, places[1:], strict=False)]
    loose = [(int(wide[i]), int(wide[j])) for i, j in rng.integers(0, 60, (45, 2)) if i != j]
    return star + path + path[:9] + [(b, a) for a, b in path[:9]] + loose


@pytest.mark.parametrize("one_task", [0, graph.ONE_TASK])
def test_components(spark, one_task):
    links = graphs()
    df = spark.createDataFrame([*links, (7, 7)], "a long, b long").repartition(5)
    got = graph.connected_components(df, one_task).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == plain_roots(links)
    assert graph.connected_components(df.limit(0), one_task).count() == 0


def test_a_small_graph_takes_few_plans(spark, monkeypatch):
    """By contractions, a path takes several rounds of joins, counts and tables, all planned by the driver."""
    written = []
    monkeypatch.setattr(graph, "saved", lambda *a, keep=graph.saved: written.append(a[1]) or keep(*a))
    got = graph.connected_components(spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.where("root = 0").count() == 301
    assert len(written) == 2
