"""A head trained so that members of one list come close, and the nulls that say what it learned.

The loss is InfoNCE: of all positives in an anchor's block, its own must score highest.  Spark
computes the gradients of all blocks and models in one job a step; the driver holds the weights.
What is trained on is a sample of bounded size (about ``most`` anchors a model); rankings and
recall cover all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from . import scoring
from .shared import kept

#: Fixed values of the GELU approximation that ``scoring.projected`` uses too.
SLOPE, CUBE = np.sqrt(2 / np.pi), 0.044715


@dataclass
class Head:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def fresh(cls, width: int, hidden: int, out: int, seed: int) -> Head:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, width**-0.5, (hidden, width)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (out, hidden)), np.zeros(out))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.w1, self.b1, self.w2, self.b2)])

    def like(self, flat: np.ndarray) -> Head:
        shapes = [x.shape for x in (self.w1, self.b1, self.w2, self.b2)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return Head(*[x.reshape(s) for x, s in zip(np.split(flat, ends), shapes, strict=True)])


def loss_and_gradient(head: Head, anchors: np.ndarray, positives: np.ndarray, lists: np.ndarray, tau: float) -> tuple[float, np.ndarray]:
    """Sums over a block's anchors; positives of an anchor's own list are no negatives of it."""
    n = len(anchors)
    x = np.concatenate([anchors, positives])
    z = x @ head.w1.T + head.b1
    t = np.tanh(SLOPE * (z + CUBE * z**3))
    h = 0.5 * z * (1 + t)
    y = h @ head.w2.T + head.b2
    norm = np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
    e = y / norm
    s = e[:n] @ e[n:].T / tau
    s[(lists[:, None] == lists) & ~np.eye(n, dtype=bool)] = -np.inf
    s -= s.max(axis=1, keepdims=True)
    p = np.exp(s)
    total = p.sum(axis=1, keepdims=True)
    loss = float((np.log(total[:, 0]) - np.diag(s)).sum())
    ds = (p / total - np.eye(n)) / tau
    de = np.concatenate([ds @ e[n:], ds.T @ e[:n]])
    dy = (de - (de * e).sum(axis=1, keepdims=True) * e) / norm
    dz = (dy @ head.w2) * (0.5 * (1 + t) + 0.5 * z * (1 - t**2) * SLOPE * (1 + 3 * CUBE * z**2))
    return loss, np.concatenate([(dz.T @ x).ravel(), dz.sum(0), (dy.T @ h).ravel(), dy.sum(0)])


def fold_of(lists: str, folds: int):
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(lists)), F.lit(folds)).cast("int")


def training_pairs(members: DataFrame, folds: int, most: int, seed: int) -> DataFrame:
    """``model``, ``fold``, ``list``, ``anchor`` and ``positive``: each member with the next one of its list, in an order by hash.

    A model never sees its fold's lists.  The ``shuffled`` models draw the members of a list
    from all of their fold's training members: each member goes to the place of another one.
    ``members`` has ``list`` and ``id``; lists of one give no pair.  A fold's sample holds each
    member with a chance that makes ``most`` of all: that number but for chance, at any size.
    """
    keyed = members.where("list IS NOT NULL AND id IS NOT NULL").select("list", "id").distinct().withColumn("own", fold_of("list", folds))
    seen = keyed.select("list", "id", "own", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")).where("own <> fold")
    sampled = F.pmod(F.xxhash64(F.lit(seed), "list", "id"), F.lit(1 << 40))
    limit = int((1 << 40) * min(1.0, most / max(1, keyed.count())))
    rows = kept(seen.withColumn("at", sampled).where(F.col("at") < limit), "anchors")
    # the sample is bounded by ``most`` a fold, and so are these windows
    place = Window.partitionBy("fold").orderBy(F.xxhash64(F.lit(seed + 1), "list", "id"), "list", "id")
    other = Window.partitionBy("fold").orderBy(F.xxhash64(F.lit(seed + 2), "list", "id"), "list", "id")
    numbered = rows.withColumn("p", F.row_number().over(place)).withColumn("q", F.row_number().over(other))
    moved = numbered.select("fold", "list", "at", F.col("q").alias("p")).join(numbered.select("fold", "p", "id"), ["fold", "p"]).select("fold", "list", "id", "at")
    both = rows.select(F.lit("trained").alias("model"), "fold", "list", "id", "at").unionByName(moved.select(F.lit("shuffled").alias("model"), "fold", "list", "id", "at"))
    ring = Window.partitionBy("model", "fold", "list").orderBy("at", "id")
    after = F.coalesce(F.lead("id").over(ring), F.first("id").over(ring.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return both.withColumn("positive", after).where("positive <> id").select("model", "fold", "list", F.col("id").alias("anchor"), "positive")


def train(pool: DataFrame, pairs: DataFrame, mean: np.ndarray, out: int = 16, hidden: int = 32, steps: int = 25, rate: float = 0.02, tau: float = 0.1, block: int = 256, seed: int = 0) -> dict[tuple[str, int], Head]:
    """A head for each ``model`` and ``fold``, by Adam over the gradients of all blocks."""
    vector = pool.select(F.col("id").alias("anchor"), F.col("vector").alias("a"))
    other = pool.select(F.col("id").alias("positive"), F.col("vector").alias("b"))
    met = pairs.join(vector, "anchor").join(other, "positive")
    sizes = {(r["model"], r["fold"]): r["count"] for r in met.groupBy("model", "fold").count().collect()}
    blocks = -(-max(sizes.values(), default=0) // block)
    if not blocks:
        return {}
    dealt = kept(met.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "anchor", "list"), F.lit(blocks))), "pairs")
    heads = {key: Head.fresh(len(mean), hidden, out, seed) for key in sorted(sizes)}
    first = {key: np.zeros_like(h.flat()) for key, h in heads.items()}
    second = {key: np.zeros_like(h.flat()) for key, h in heads.items()}

    def unit(v: pd.Series) -> np.ndarray:
        x = np.array(v.tolist(), dtype=np.float64) - mean
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def gradients(now: dict):
        def gradient(key, rows):
            rows = rows.sort_values(["anchor", "list", "positive"])
            _, g = loss_and_gradient(now[key[0], key[1]], unit(rows["a"]), unit(rows["b"]), rows["list"].to_numpy(), tau)
            return pd.DataFrame({"model": [key[0]], "fold": [key[1]], "block": [key[2]], "g": [g]})

        return gradient

    for step in range(1, steps + 1):
        # a row a block of the bounded sample, added in order so that reruns agree
        found = dealt.groupBy("model", "fold", "block").applyInPandas(gradients(dict(heads)), "model string, fold int, block long, g array<double>")
        sums = {key: np.zeros_like(first[key]) for key in heads}
        for r in sorted(found.collect(), key=lambda r: r["block"]):
            sums[r["model"], r["fold"]] += np.array(r["g"])
        for key, h in heads.items():
            g = sums[key] / sizes[key]
            first[key] = 0.9 * first[key] + 0.1 * g
            second[key] = 0.999 * second[key] + 0.001 * g * g
            move = first[key] / (1 - 0.9**step) / (np.sqrt(second[key] / (1 - 0.999**step)) + 1e-8)
            heads[key] = h.like(h.flat() - rate * move)
    return heads


def _prior(members: DataFrame, top: DataFrame, fold: int, folds: int, k: int) -> DataFrame:
    """As ``_recall``, where one order (``top``: ``id``, ``r``) serves all seeds and only skips the seed itself."""
    held = members.where(fold_of("list", folds) == fold).join(F.broadcast(top), "id", "left")
    sizes = held.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") <= k).alias("first"), F.count("r").alias("more")).where("n > 1")
    hits = F.when(F.col("r") <= k, F.col("more") - 1).otherwise(F.col("first"))
    return held.join(sizes, "list").agg(F.round(F.avg(hits / F.least(F.col("n") - 1, F.lit(k))), 9).alias("recall"), F.count(F.lit(1)).alias("seeds"))


def _recall(members: DataFrame, found: DataFrame, fold: int, folds: int, k: int) -> DataFrame:
    """Mean share of the ``k`` best that a seed's list gives, over all members of the fold's lists (``found``: ``id``, ``neighbour``)."""
    held = members.where(fold_of("list", folds) == fold)
    sizes = held.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    seeds = held.join(sizes, "list")
    hits = found.join(seeds.select("list", "id"), "id").join(held.select("list", F.col("id").alias("neighbour")), ["list", "neighbour"]).groupBy("list", "id").agg(F.count(F.lit(1)).alias("hits"))
    share = F.coalesce("hits", F.lit(0)) / F.least(F.col("n") - 1, F.lit(k))
    return seeds.join(hits, ["list", "id"], "left").agg(F.round(F.avg(share), 9).alias("recall"), F.count(F.lit(1)).alias("seeds"))


def head_report(pool: DataFrame, members: DataFrame, folds: int = 2, k: int = 25, most: int = 8192, seed: int = 0) -> DataFrame:
    """``fold``, ``version``, ``recall`` and ``seeds``: the plain vectors, the trained head, the head
    of shuffled lists, and a prior that ignores the seed and knows only which items training saw.

    ``pool`` has ``id`` and ``vector``; ``members`` has ``list`` and ``id``, rows of items without
    a vector do not count; repeated rows count once; fewer than two lists give rows without recall.
    """
    spark = pool.sparkSession
    pool = kept(pool.where("vector IS NOT NULL").select("id", "vector"), "pool")
    members = kept(members.join(pool.select("id"), "id", "left_semi").select("list", "id").distinct(), "members")
    if pool.isEmpty():
        return spark.createDataFrame([], "fold int, version string, recall double, seeds long")
    mean = np.array(vectors.centroid(pool, "vector").first()[0])
    heads = train(pool, training_pairs(members, folds, most, seed), mean, seed=seed)
    plain = kept(scoring.nearest(pool, k), "near")
    out, by_hash = [], (F.xxhash64(F.lit(seed), "id"), F.col("id"))
    for fold in range(folds):
        seen = members.where(fold_of("list", folds) != fold).select("id").distinct()
        versions = {"plain": plain}
        for model in ("trained", "shuffled"):
            if (model, fold) in heads:
                h = heads[model, fold]
                versions[model] = scoring.nearest(scoring.projected(pool, h.w1, h.b1, h.w2, h.b2, mean), k)
        out += [_recall(members, found, fold, folds, k).select(F.lit(fold).alias("fold"), F.lit(name).alias("version"), "recall", "seeds") for name, found in versions.items()]
        # the k + 1 items that the prior ranks first, for every seed alike
        top = seen.orderBy(*by_hash).limit(k + 1).withColumn("r", F.row_number().over(Window.orderBy(*by_hash)))
        out.append(_prior(members, top, fold, folds, k).select(F.lit(fold).alias("fold"), F.lit("prior").alias("version"), "recall", "seeds"))
    report = out[0]
    for part in out[1:]:
        report = report.unionByName(part)
    return report

