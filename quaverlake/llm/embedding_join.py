"""Embedding near-dedup: an exact metric range join over pivots.

Vectors are scaled to unit length, where a cosine of ``t`` is a distance of
``r = sqrt(2 - 2 t)``.  A bounded number of pivots, drawn from the vectors by hash,
cut the space into cells by nearest pivot.  A pair within ``r`` has its vectors in
one cell or in two; for two, the vector of the later cell visits the earlier one.
It need only do so where the triangle inequality allows a partner there: its
distance to that cell's pivot is at most the cell's radius plus ``r``, and at most
its distance to its own pivot plus ``2 r`` (sharpened to: its distance to the plane
between the two pivots is at most ``r``).  Each cell then joins independently.

Cells are cut into blocks, and each pair of blocks is one task of bounded size: a
matrix product in single precision finds candidates with a margin, doubtful ones
are decided in double precision.  A task returns, for each vector, the number of
its links and a forest of them, never all pairs.

Equal vectors are one class from the start.  How far cells prune depends on the
data: near-random directions in many dimensions lie about as far from every pivot,
and then most vectors visit most cells, as in any exact metric index.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length do not link; vectors
with a null id link, and name a group only where it has no other id; repeated ids
are compared like others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups, table
from .graph import connected_components, forest

#: Bounds what is collected and broadcast: pivots, and one radius and count each.
MAX_PIVOTS = 4096
CELL_ROWS = 4096
HOME_BLOCK = 4096
VISITOR_BLOCK = 16384
SLACK = 1e-6
MARGIN = 1e-4


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Cells:
    """Pivots of one vector length, with the radius of each cell once known."""

    def __init__(self, pivots: np.ndarray, r: float):
        self.pivots, self.r, self.radius = pivots, r, np.full(len(pivots), np.inf)

    def distances(self, units: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * units @ self.pivots.T))

    def visits(self, d: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Which earlier cells each vector must visit."""
        own = d[np.arange(len(d)), home][:, None]
        homes, at = np.unique(home, return_inverse=True)
        between = np.sqrt(np.maximum(0, 2 - 2 * self.pivots[homes] @ self.pivots.T))[at]
        plane = (d * d - own * own) <= 2 * (self.r + SLACK) * between + SLACK
        near = (d <= self.radius + self.r + SLACK) & (d <= own + 2 * self.r + SLACK) & plane
        return near & (np.arange(d.shape[1]) < home[:, None])


def _deal(batches: Iterator[pd.DataFrame], spaces: dict[int, Cells], r: float) -> Iterator[pd.DataFrame]:
    """Each vector at home in its cell and as a visitor in others; a length without pivots is one cell."""
    for batch in batches:
        for length, rows in batch.groupby(batch["embedding"].map(len)):
            cells = spaces.get(length) or Cells(np.eye(1, length), r)
            d = cells.distances(_units(rows["embedding"]))
            home = d.argmin(axis=1)
            rows = rows.reset_index(drop=True).assign(length=length)
            own = d[np.arange(len(d)), home]
            yield rows.assign(cell=home, visitor=False, d=own)
            at, cell = np.nonzero(cells.visits(d, home))
            yield rows.iloc[at].assign(cell=cell, visitor=True, d=d[at, cell])


def _join_blocks(key: tuple, rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of the home vectors of a cell among themselves, or with its visitors."""
    (_, _, one, two, visiting), n = key, len(rows)
    units, weight = _units(rows["embedding"]), rows["copies"].to_numpy()
    left = np.flatnonzero(~rows["visitor"] & (rows["block"] == one))
    right = np.flatnonzero(rows["visitor"] == visiting) if visiting else np.flatnonzero(rows["block"] == two)
    same = not visiting and one == two
    single = units.astype(np.float32)
    links = np.zeros(n, dtype=np.int64)

    def found():
        for at in range(0, len(left), 512):
            part = left[at : at + 512]
            cos = single[part] @ single[right].T
            i, j = np.nonzero(cos >= least - MARGIN)
            i, j, sure = part[i], right[j], cos[i, j] >= least + MARGIN
            if same:
                ahead = i < j
                i, j, sure = i[ahead], j[ahead], sure[ahead]
            doubt = np.flatnonzero(~sure)
            sure[doubt] = np.einsum("ij,ij->i", units[i[doubt]], units[j[doubt]]) >= least
            i, j = i[sure], j[sure]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            cuts = np.flatnonzero(np.diff(i)) + 1
            yield from ((int(a[0]), b) for a, b in zip(np.split(i, cuts), np.split(j, cuts), strict=True) if len(a))

    ids = rows["class_id"].to_numpy()
    # the forest takes links as they are found, so that a dense cell's are never held together
    tree = np.array(forest(n, found()), dtype=np.int64).reshape(-1, 2)
    counted = np.flatnonzero(links)
    return pd.DataFrame(
        {
            "class_id": np.concatenate([ids[counted], ids[tree[:, 0]]]),
            "links": np.concatenate([links[counted], np.zeros(len(tree), dtype=np.int64)]),
            "other": pd.array(np.concatenate([np.full(len(counted), -1), ids[tree[:, 1]]]), dtype="int64"),
        }
    )


def _pivots(classes: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """Pivots by vector length: the vectors with the least hashes, one for each ``CELL_ROWS``, up to ``MAX_PIVOTS``."""
    wanted = int(max(1, min(MAX_PIVOTS, -(-rows // CELL_ROWS))))
    picked = classes.orderBy(F.xxhash64("embedding"), "class_id").select("embedding").limit(wanted).toPandas()["embedding"]
    return {int(n): _units(own) for n, own in picked.groupby(picked.map(len))}


def similarity_join(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """Per row: ``n_links``, ``component_id`` and ``kept``, with the row's id."""
    vectors = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.withColumn("usable", usable)
    grouped = rows.where("usable").groupBy("embedding").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = cut(grouped.withColumn("class_id", F.monotonically_increasing_id()))
    r = float(np.sqrt(max(0.0, 2 - 2 * least)))
    spaces = {n: Cells(p, r) for n, p in _pivots(classes, classes.count()).items()}
    schema = "embedding {}, copies long, class_id long, length int, cell int, visitor boolean, d double".format(dict(classes.dtypes)["embedding"])
    slim = classes.select("embedding", "copies", "class_id")

    def dealt():
        return slim.mapInPandas(lambda batches: _deal(batches, spaces, r), schema)

    # no more rows than pivots
    known = F.col("length").isin(list(spaces))
    for x in dealt().where(known & ~F.col("visitor")).groupBy("length", "cell").agg(F.max("d").alias("radius")).collect():
        spaces[x["length"]].radius[x["cell"]] = x["radius"]
    placed = cut(dealt())
    sizes = placed.groupBy("length", "cell").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("visitor")) / HOME_BLOCK)).cast("int").alias("homes"),
        F.ceil(F.count_if("visitor") / VISITOR_BLOCK).cast("int").alias("visits"),
    )
    blocked = placed.join(F.broadcast(sizes), ["length", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("class_id"), F.when(F.col("visitor"), F.col("visits")).otherwise(F.col("homes"))).cast("int")
    )
    step = lambda n: F.sequence(F.lit(0), n - 1)
    none = F.array().cast("array<struct<one:int,two:int,visiting:boolean>>")
    own = F.transform(step(F.col("homes")), lambda k: F.struct(F.least(k, "block").alias("one"), F.greatest(k, "block").alias("two"), F.lit(False).alias("visiting")))
    met = F.when(F.col("visits") > 0, F.transform(step(F.col("visits")), lambda k: F.struct(F.col("block").alias("one"), k.alias("two"), F.lit(True).alias("visiting")))).otherwise(none)
    went = F.transform(step(F.col("homes")), lambda k: F.struct(k.alias("one"), F.col("block").alias("two"), F.lit(True).alias("visiting")))
    tasks = F.explode(F.when(F.col("visitor"), went).otherwise(F.concat(own, met))).alias("task")
    pieces = blocked.select("length", "cell", "embedding", "copies", "class_id", "visitor", "block", tasks).select(
        "length", "cell", "embedding", "copies", "class_id", "visitor", "block", "task.one", "task.two", "task.visiting"
    )
    found = cut(
        pieces.groupBy("length", "cell", "one", "two", "visiting").applyInPandas(
            lambda key, rows: _join_blocks(key, rows, least), "class_id long, links long, other long"
        )
    )
    links = found.where("links > 0").groupBy("class_id").agg(F.sum("links").alias("links"))
    members = connected_components(found.where("other >= 0").select(F.col("class_id").alias("a"), F.col("other").alias("b")))
    rooted = members.withColumnRenamed("node", "class_id").join(classes.select("class_id", "least"), "class_id")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("class_id", "component")
    facts = classes.join(links, "class_id", "left").join(named, "class_id", "left").select(
        "embedding",
        F.col("copies").alias("__rows"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "least").alias("component_id"),
    )
    joined = join_groups(rows.where("usable"), facts, "embedding", rows.count(), F.col("id")).select("id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = joined.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
