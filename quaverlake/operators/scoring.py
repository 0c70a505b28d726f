"""Similarity terms, their fusion, and neighbour searches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from .ranks import percentiles
from .shared import kept, merged

#: Default weights of the terms, and the scales of the gaps.
WEIGHTS = {"clap": 1.0, "genre": 0.3, "bpm": 0.3, "era": 0.1}
BPM_SCALE, YEAR_SCALE, LOUD_SCALE = 40.0, 25.0, 10.0


def terms(pairs: DataFrame) -> DataFrame:
    """Terms of (seed_*, *) pairs: gaps are negated, so that more is better in each."""
    return pairs.select(
        "seed_id",
        "id",
        F.round(vectors.dot(F.col("seed_vector"), F.col("vector")), 9).alias("clap"),
        F.round(text.jaccard(F.col("seed_tags"), F.col("tags")), 9).alias("genre"),
        F.round(-text.gap(F.col("seed_bpm"), F.col("bpm"), BPM_SCALE), 9).alias("bpm"),
        F.round(-text.gap(F.col("seed_year"), F.col("year"), YEAR_SCALE), 9).alias("era"),
    )


def fused(table: DataFrame, how: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``contributions`` of each term and their sum, ``score``; statistics are over the seed's whole pool.

    Moments are one row a seed, and percentiles come from ranges of values, so that no
    task holds a pool.  A term that is null for a seed has null contributions.
    """
    used = {t: w for t, w in weights.items() if w}
    if how == "raw" or not used:
        on_scale, value = table, {t: F.col(t) for t in used}
    elif how == "rank":
        places = percentiles(table, list(used)).withColumnsRenamed({t: f"p_{t}" for t in used})
        on_scale, value = table.join(places, ["seed_id", "id"]), {t: F.col(f"p_{t}") for t in used}
    else:
        moments = table.groupBy("seed_id").agg(*[f(t).alias(f"{n}_{t}") for t in used for n, f in (("m", F.avg), ("s", F.stddev_pop))])
        on_scale = table.join(moments, "seed_id")
        value = {t: F.when(F.col(t).isNotNull(), F.when(F.col(f"s_{t}") > 1e-12, (F.col(t) - F.col(f"m_{t}")) / F.col(f"s_{t}")).otherwise(0.0)) for t in used}
    parts = on_scale.select(*table.columns, *[(F.lit(w) * value[t]).alias(f"c_{t}") for t, w in used.items()])
    return parts.withColumn("score", sum((F.col(f"c_{t}") for t in used), F.lit(0.0)))


def seed_pairs(pool: DataFrame, seeds: list[int]) -> DataFrame:
    """Each pool row with each seed's columns (named ``seed_*``).  The seeds are a few rows of the request."""
    chosen = pool.where(F.col("id").isin(seeds)).select(*[F.col(c).alias(f"seed_{c}") for c in pool.columns])
    return pool.crossJoin(F.broadcast(chosen))


#: At most so many cells, whose centres the driver and each task hold.
MOST_CELLS = 1024
#: Rows of a block where none is given: a share of the pool, so that each row travels to about as many blocks at any size, between bounds.
SHARE, LEAST_BLOCK, MOST_BLOCK = 12, 2048, 65536
#: Cosines that a task holds at a time, and what rounding to nine digits may add.
HELD, MARGIN = 1 << 23, 1e-9


class Cells:
    """Rows dealt to cells by their nearest pivot, and cells to blocks of about ``size`` rows.

    By the triangle inequality, rows of two cells are no nearer than their pivots' distance
    less both radii; with the greatest norms that bounds the dot product of any two rows,
    and blocks that the bound rules out are never compared.  Pivots are the first rows by
    a hash of their id, one for ``size`` rows.
    """

    def __init__(self, pool: DataFrame, size: int | None = None):
        n = pool.count()
        size = size or min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // SHARE)))
        first = pool.orderBy(F.xxhash64("id"), "id").limit(min(MOST_CELLS, max(1, -(-n // size)))).select("vector")
        pivots = np.array([r["vector"] for r in first.collect()], dtype=np.float64)

        @F.pandas_udf("struct<cell:int,far:double,norm:double>")
        def placed(v: pd.Series) -> pd.DataFrame:
            x = np.array(v.tolist(), dtype=np.float64)
            squares = (x * x).sum(axis=1)
            apart = squares[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(axis=1)
            cell = apart.argmin(axis=1)
            return pd.DataFrame({"cell": cell, "far": np.sqrt(np.maximum(apart[np.arange(len(x)), cell], 0)), "norm": np.sqrt(squares)})

        self.rows = kept(pool.select("id", "vector", placed("vector").alias("at")).select("id", "vector", "at.*"), "cells") if n else pool.select("id", "vector", F.lit(0).alias("cell"))
        stats = {r["cell"]: r for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()} if n else {}
        self.cells = sorted(stats)
        self.parts = {c: -(-stats[c]["n"] // size) for c in self.cells}
        if not n:
            return
        far, norm = (np.array([stats[c][k] for c in self.cells]) for k in ("far", "norm"))
        p = pivots[self.cells]
        apart = np.sqrt(np.maximum(((p[:, None] - p[None]) ** 2).sum(axis=2), 0)) if len(p) <= 256 else np.sqrt(np.maximum((p * p).sum(1)[:, None] - 2 * p @ p.T + (p * p).sum(1), 0))
        least = np.maximum(apart - far[:, None] - far[None], 0)
        #: No dot product of rows of two cells is greater; a margin covers rounding.
        self.most = ((norm**2)[:, None] + (norm**2)[None] - least**2) / 2 + 1e-6

    def pairs(self, wanted: np.ndarray, ordered: bool) -> DataFrame:
        """Rows dealt to pairs of blocks (``one``, ``two``), as ``left`` side and as right side; ``wanted[a, b]`` says whether rows of cell a need those of cell b."""
        spark, many = self.rows.sparkSession, max(self.parts.values(), default=1)
        needs = [(self.cells[a], self.cells[b], self.parts[self.cells[b]], self.parts[self.cells[a]]) for a, b in zip(*np.nonzero(wanted), strict=True)]
        table = spark.createDataFrame([tuple(map(int, x)) for x in needs], "cell int, other int, other_parts int, own_parts int")
        carried = [c for c in self.rows.columns if c not in ("id", "vector", "cell", "far", "norm")]
        code = lambda cell, part: F.col(cell).cast("long") * many + part
        own = self.rows.join(table.select("cell", "own_parts").distinct(), "cell").withColumn("block", code("cell", F.pmod(F.xxhash64("id"), F.col("own_parts")))).drop("own_parts")
        spread = lambda t: t.select("cell", "other", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)).alias("part")).select("cell", code("other", F.col("part")).alias("partner"))
        back = table.select(F.col("other").alias("cell"), F.col("cell").alias("other"), F.col("own_parts").alias("other_parts"))
        left = own.join(spread(table), "cell").select("id", "vector", *carried, F.col("block").alias("one"), F.col("partner").alias("two"), F.lit(True).alias("left"))
        right = own.join(spread(back), "cell").select("id", "vector", *carried, F.col("partner").alias("one"), F.col("block").alias("two"), F.lit(False).alias("left"))
        both = left.unionByName(right)
        return both.where("one <= two") if ordered else both


def _sides(rows: pd.DataFrame):
    sides = []
    for flag in (True, False):
        side = rows[rows["left"] == flag].sort_values("id")
        sides.append((side["id"].to_numpy(), np.array(side["vector"].tolist(), dtype=np.float64)))
    return sides


def _products(a: np.ndarray, b: np.ndarray):
    """Dot products of both sides, a bounded number of left rows at a time, each time with the first one's place."""
    step = max(1, HELD // len(b))
    for at in range(0, len(a), step):
        yield at, a[at : at + step] @ b.T


def similar_pairs(pool: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """Pairs ``a < b`` of (``id``, ``vector``) with a cosine of ``least`` or more, by matrix products of the blocks that can have such pairs."""
    cells = Cells(pool, block)
    if not cells.cells:
        return pool.sparkSession.createDataFrame([], "a long, b long, cosine double")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        (ia, a), (ib, b) = _sides(rows)
        if not len(ia) or not len(ib):
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        same, out = rows["one"].iloc[0] == rows["two"].iloc[0], []
        for at, s in _products(a, b):
            i, j = np.nonzero(s >= least - MARGIN)
            cosine, i = np.round(s[i, j], 9), i + at
            # within one block each pair shows twice; across blocks once, in either order
            keep = (cosine >= least) & (ia[i] < ib[j]) if same else cosine >= least
            out.append((np.minimum(ia[i], ib[j])[keep], np.maximum(ia[i], ib[j])[keep], cosine[keep]))
        return pd.DataFrame(dict(zip(("a", "b", "cosine"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return cells.pairs(cells.most >= least, True).groupBy("one", "two").applyInPandas(one, "a long, b long, cosine double")


def best_of(s: np.ndarray, own: np.ndarray, k: int, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (row, column) and rounded values of the ``k`` greatest of each row, the first of equals; those below ``sure`` may be left out.

    ``own`` marks what does not count.  Where few values reach ``sure``, only these are
    looked at; other rows are cut at their k-th value.
    """
    reach = (s >= sure[:, None] - MARGIN) & ~own
    few = np.isfinite(sure) & (reach.sum(axis=1) <= 4 * k)
    i, j = np.nonzero(reach & few[:, None])
    found = [(i, j, np.round(s[i, j], 9))]
    many = np.nonzero(~few)[0]
    if len(many):
        rest = np.where(own[many], -np.inf, np.round(s[many], 9))
        n = min(k, rest.shape[1])
        edge = np.partition(rest, rest.shape[1] - n, axis=1)[:, [rest.shape[1] - n]]
        above, level = rest > edge, rest == edge
        i, j = np.nonzero((above | level & (level.cumsum(axis=1, dtype=np.int32) <= n - above.sum(axis=1, keepdims=True))) & np.isfinite(rest))
        found.append((many[i], j, rest[i, j]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(pool: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """The ``k`` nearest others of every row: ``id``, ``neighbour``, ``cosine`` and ``rank``.

    A first pass within blocks finds how near the k-th of each row is at least; a block
    is then compared with those alone that can hold nearer ones for some row of its cell,
    and gives only what is as near as that.
    """
    cells = Cells(pool, block)
    if not cells.cells:
        return pool.sparkSession.createDataFrame([], "id long, neighbour long, cosine double, rank int")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        (ia, a), (ib, b) = _sides(rows)
        if not len(ia) or not len(ib):
            return pd.DataFrame({"id": [], "neighbour": [], "cosine": []})
        sure = rows[rows["left"]].sort_values("id")["sure"].fillna(-np.inf).to_numpy() if "sure" in rows else np.full(len(ia), -np.inf)
        out = []
        for at, s in _products(a, b):
            ids = ia[at : at + len(s)]
            i, j, cosine = best_of(s, ids[:, None] == ib, k, sure[at : at + len(s)])
            out.append((ids[i], ib[j], cosine))
        return pd.DataFrame(dict(zip(("id", "neighbour", "cosine"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    def best(dealt: DataFrame) -> DataFrame:
        return dealt.groupBy("one", "two").applyInPandas(one, "id long, neighbour long, cosine double")

    wanted = np.full(cells.most.shape, True)
    if sum(cells.parts.values()) > 1:
        own = cells.pairs(np.eye(len(cells.cells), dtype=bool), False).where("one = two")
        sure = best(own).groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).alias("sure"))
        cells.rows = kept(merged(cells.rows, sure, "id", "left"), "sure")
        found = {r["cell"]: r["sure"] for r in cells.rows.groupBy("cell").agg(F.min(F.coalesce("sure", F.lit(float("-inf")))).alias("sure")).collect()}
        wanted = cells.most >= np.array([found[c] for c in cells.cells])[:, None]
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return best(cells.pairs(wanted, False)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def without_top(pool: DataFrame, directions: int) -> DataFrame:
    """Centred unit vectors less their projection on the top directions of the pool."""
    d = pool.select(F.size("vector")).first()[0]
    mean = np.array(vectors.centroid(pool, "vector").first()[0])

    def moments(batches):
        for batch in batches:
            x = np.array(batch["vector"].tolist(), dtype=np.float64) - mean
            yield pd.DataFrame({"i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "s": (x.T @ x).ravel()})

    cells = pool.select("vector").mapInPandas(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    m = np.zeros((d, d))
    m[cells["i"], cells["j"]] = cells["s"]
    top = np.linalg.eigh(m)[1][:, d - directions :]

    @F.pandas_udf("array<double>")
    def cleaned(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=np.float64) - mean
        x = x - (x @ top) @ top.T
        return pd.Series(list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)))

    return pool.withColumn("vector", cleaned("vector"))


def projected(pool: DataFrame, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray, mean: np.ndarray) -> DataFrame:
    """A two-layer head with GELU between, on centred unit vectors; the result has unit length."""

    @F.pandas_udf("array<double>")
    def head(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=np.float64) - mean
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        h = x @ w1.T + b1
        h = 0.5 * h * (1 + np.tanh(np.sqrt(2 / np.pi) * (h + 0.044715 * h**3)))
        y = h @ w2.T + b2
        return pd.Series(list(y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)))

    return pool.withColumn("vector", head("vector"))


def tag_clusters(pool: DataFrame, k: int, seed: int = 0, tries: int = 10) -> DataFrame:
    """K-means clusters of (``id``, ``vector``), the best of several starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = pool.withColumn("features", array_to_vector(vectors.doubles(F.col("vector"))))
    models = [KMeans(k=k, seed=seed + t, predictionCol="cluster").fit(data) for t in range(tries)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).drop("features")
