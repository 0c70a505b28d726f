"""Connected components: of a small graph in one task, of a larger one by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_dealt, new_folder, saved

#: Links that one task joins at most, in some 200 MB of numpy; more are contracted over Spark.
ONE_TASK = 1 << 20


def forest(nodes: int, links: Iterable[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that keep the connections of all of ``links`` (a node and its neighbours, nearest first).

    At most ``nodes - 1``: each joins two components seen so far.
    """
    label, kept = np.arange(nodes), []
    for node, neighbours in links:
        roots = label[neighbours]
        if (roots == label[node]).all():
            continue
        found, first = np.unique(roots, return_index=True)
        kept += [(node, int(neighbours[k])) for r, k in zip(found, first, strict=True) if r != label[node]]
        found = np.append(found, label[node])
        label[np.isin(label, found)] = found.min()
    return kept


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One contraction: every node sends neighbours to the least node it knows.

    ``edges`` (``total``, ``a > b``).  The large star moves the larger neighbours of each
    node, the small star the smaller ones and the node itself.  A root with very many
    neighbours has them dealt over tasks.
    """
    both, total = (edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * total) if large else (edges, total)
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("__rows"))
    joined = join_dealt(both, least.select("a", "m"), "a", least.select("a", "__rows"), total, F.col("b"))
    moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _flatness(edges: DataFrame) -> tuple[int, bool]:
    """The number of ``edges`` (``a > b``, distinct), and whether all components are stars about their least node."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("above")).unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("above")))
    nodes = ends.groupBy("node").agg(F.count("above").alias("n"), F.count_if(F.col("above").isNull()).alias("below"))
    bad = (F.col("n") > 1) | ((F.col("n") == 1) & (F.col("below") > 0))
    total, wrong = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(bad)).first()
    return total, wrong == 0


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        one, other = label[a], label[b]
        apart = one != other
        if not apart.any():
            return nodes, nodes[label]
        a, b, one, other = a[apart], b[apart], one[apart], other[apart]
        np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
        while (label[label] != label).any():
            label = label[label]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if frames:
            node, root = least_nodes(*(np.concatenate([x[c].to_numpy() for x in frames]) for c in "ab"))
            yield pd.DataFrame({"node": node, "root": root})

    return saved(edges.coalesce(1).mapInPandas(joined, "node long, root long"), "roots")


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``node`` and ``root`` (its component's least node) for every node of ``edges`` (``a``, ``b``: long).

    Up to ``one_task`` distinct links are joined in one task: the contractions of a small
    graph cost the driver more, in plans and their jobs, than the graph has.  Those of a
    larger one are each written to the shared folder, and the one before it deleted; a
    component of diameter ``d`` takes about ``log d`` rounds.
    """
    spark = edges.sparkSession
    path = new_folder(spark, "edges")
    current = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", path)
    if current.count() <= one_task:
        found = _in_one_task(current)
        discard(spark, path)
        return found
    while True:
        total, flat = _flatness(current)
        if flat:
            break
        for large in (True, False):
            old, path = path, new_folder(spark, "edges")
            current = saved(_star(current, large, total), "edges", path)
            total = current.count() if large else total
            discard(spark, old)
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
