"""Conversation prefix trie from the Cartesian tree of the LCP array.

Conversations become sequences of turns, and equal sequences one row.  These rows are
sorted by sequence and cut into blocks.  ``lcp[i]`` is the number of leading turns that
row i shares with the row before it; its Cartesian tree is the trie without the nodes
of one child:

* All nearest smaller values.  Each block finds, with a stack, the nearest place with a
  smaller value to both sides, as far as it lies in the block.  For what is left, the
  nearest block whose minimum is smaller is found from the blocks' minima, and the place
  in it by a join on block and value with that block's suffix (or prefix) minima.
* The rows between the two places are a node's members, its depth is the value.  Places
  of equal value between the same two are one node; their number gives its children.
* A row deeper than the values at both of its ends has a leaf.
* Between a node and its parent, the greater of the values at its two ends, lie missing
  depths, with the same members each: a node's row is expanded to all of them.

Sums over members are differences of prefix sums within blocks and over blocks' totals,
minima are range minima.  The tokens saved below a node are taken from such sums as
well: texts counted once a member less texts counted once a node, where row i adds to
the nodes those of its turns beyond ``lcp[i]``.

The driver and each task hold a few numbers a block; there are at most ``MOST_BLOCKS``.

Defined cases: null role and text are empty; a null turn comes first, and equal turn
numbers are ordered by a digest of role and text, so that repeated rows count each;
rows without a conversation id belong to none and are left out; a conversation without
turns ends in the root; texts count whole, and travel as digests of 128 bits; a
conversation's digests are one row, so its length is bounded by memory; so are the
ids that end in one node, whose joined text has to be hashed at once; an empty table
gives an empty result, without a root; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table

#: Characters of a turn's digest.
DIGEST = 32
BLOCK_ROWS = 4096
MOST_BLOCKS = 16384
NO_ROWS = np.iinfo(np.int64).max
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: ``conv_id`` and ``turns``, an array of (digest, points) in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col(turn_col).isNotNull().alias("there"), F.coalesce(F.col(turn_col), F.lit(0)).alias("turn"), digest.alias("digest"), F.length(text).alias("points"))
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("turn"))
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["points"].alias("points"))).alias("turns"))


def rebuilt(whole: DataFrame) -> DataFrame:
    """The conversations of ``query``: the first h turns of the hundred's first conversation, then the own ones after the first h."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    heads = whole.where("conv_id % 100 = 0").select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, 5).alias("head"))
    joined = whole.join(heads, F.col("head_id") == F.col("conv_id") - F.col("conv_id") % 100, "left").withColumn("h", h)
    none = F.slice("turns", 1, 0)
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def distinct_sequences(whole: DataFrame) -> DataFrame:
    """One row a sequence: ``key``, ``points``, and of its conversations the least id, the number and the digest of their ids."""
    rows = whole.select("conv_id", F.array_join("turns.digest", "").alias("key"), F.col("turns.points").alias("points"))
    return rows.groupBy("key").agg(
        F.any_value("points").alias("points"), F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ","), 256).alias("ends"),
    )


def shared_turns(a: str, b: str) -> int:
    """Number of leading turns that two keys share."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[:DIGEST] != b[:DIGEST]:
        return 0
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


@dataclass
class Blocks:
    """The blocks in order, and of each its first place and the shared turns there."""

    number: list[int]
    start: list[int]
    first: list[int]
    rows: int

    @staticmethod
    def of(ordered: DataFrame) -> Blocks:
        # one row a block, with two keys; only numbers reach the driver
        ends = saved(ordered.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("rows")), "block-ends")
        counts = sorted((r["block"], r["rows"]) for r in ends.select("block", "rows").collect())
        number = [b for b, _ in counts]
        start = np.concatenate([[0], np.cumsum([n for _, n in counts])]).astype(int).tolist()
        first = [-1] * len(number)
        if len(number) > 1:
            after = ends.sparkSession.createDataFrame(list(zip(number, number[1:], strict=False)), "block int, next int")
            pairs = ends.select("block", "high").join(after, "block").join(ends.select(F.col("block").alias("next"), "low"), "next")

            @F.pandas_udf("int")
            def shared(high: pd.Series, low: pd.Series) -> pd.Series:
                return pd.Series([shared_turns(a, b) for a, b in zip(high, low, strict=True)], dtype="int32")

            found = {r["next"]: r["shared"] for r in pairs.select("next", shared("high", "low").alias("shared")).collect()}
            first[1:] = [found[b] for b in number[1:]]
        return Blocks(number, start[:-1], first, start[-1])


class RangeMin:
    """Minima of ranges of an array, from those of its stretches of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [np.asarray(values, dtype=np.int64)]
        while len(self.levels[-1]) > (width := 1 << (len(self.levels) - 1)):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))

    def __call__(self, a: int, b: int) -> int:
        """Over a to b - 1; ``NO_ROWS`` of no element."""
        if a >= b:
            return NO_ROWS
        k = (b - a).bit_length() - 1
        return int(min(self.levels[k][a], self.levels[k][b - (1 << k)]))


def nearest_smaller(values: list[int]) -> list[int]:
    """Of each element the place of the nearest smaller one before it, or -1."""
    out, stack = [], []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] >= v:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return out


#: Sums over rows: conversations, leaves, texts counted once a conversation, and texts of nodes that a row adds.
SUMS = ["n", "leaves", "texts", "fresh"]
LOCAL = (
    "kind string, block int, rep long, depth int, above int, equal int, parent_rep long, parent_conv long, before array<long>,"
    " left_place long, left_value int, left_rep long, right_place long, right_value int, right_rep long,"
    " end_depth int, ends string, total long, low int, n long, leaves long, texts long, fresh long, least long"
)
FIELDS = [column.split()[0] for column in LOCAL.split(",")]


def of_block(rows: pd.DataFrame, blocks: Blocks) -> Iterator[dict]:
    """A block's leaves, nodes, suffix and prefix minima, and totals.

    Nodes that reach over a border of the block have no place on that side, and their sums are those of their rows in the block.
    """
    rows = rows.sort_values("row")
    number = int(rows["block"].iloc[0])
    k = blocks.number.index(number)
    offset, keys, m = blocks.start[k], rows["key"].tolist(), len(rows)
    after = blocks.first[k + 1] if k + 1 < len(blocks.first) else -1
    lcp = [blocks.first[k], *(shared_turns(a, b) for a, b in zip(keys, keys[1:], strict=False)), after]
    sums = [np.concatenate([[0], np.cumsum(p)]).astype(np.int64) for p in rows["points"]]  # of a row's first d texts
    length = [len(key) // DIGEST for key in keys]
    total = [int(s[-1]) for s in sums]
    count, least, ends = rows["n"].tolist(), rows["least"].tolist(), rows["ends"].tolist()
    is_leaf = [length[i] > max(lcp[i], lcp[i + 1]) for i in range(m)]
    fresh = [total[i] - int(sums[i][max(0, lcp[i])]) for i in range(m)]
    ahead = {c: np.concatenate([[0], np.cumsum(np.array(v, dtype=np.int64))]) for c, v in zip(SUMS, (count, is_leaf, [c * t for c, t in zip(count, total, strict=True)], fresh), strict=True)}
    lowest = RangeMin(np.array(least))

    def over(a: int, b: int, first_is_fresh: bool) -> dict:
        """Sums over rows a to b - 1; the texts that row a adds count only where it isn't the node's first row."""
        found = {c: int(x[b] - x[a]) for c, x in ahead.items()}
        if not first_is_fresh:
            found["fresh"] -= fresh[a]
        return found | {"least": lowest(a, b)}

    # places 0 to m - 1 lie before their rows; nodes are [depth, left, right, rep, places]
    nodes, stack, of_place = [], [], []
    for i in range(m):
        v = lcp[i]
        while stack and nodes[stack[-1]][0] > v:
            nodes[stack.pop()][2] = i
        if stack and nodes[stack[-1]][0] == v:
            node = stack[-1]
            nodes[node][4].append(i)
        else:
            node = len(nodes)
            nodes.append([v, nodes[stack[-1]][4][-1] if stack else None, None, i, [i]])
            stack.append(node)
        of_place.append(node)

    def rep(i: int) -> int:
        return offset + (nodes[of_place[i]][3] if i < m else m)

    def side(name: str, i: int | None) -> dict:
        return {} if i is None else {f"{name}_place": offset + i, f"{name}_value": lcp[i], f"{name}_rep": rep(i)}

    def least_of(i: int) -> int | None:
        """The least id of the node at a place, where the block has all of it."""
        if i == m:
            return None
        _, left, right, _, _ = nodes[of_place[i]]
        return None if left is None or right is None else lowest(left, right)

    for v, left, right, first, places in nodes:
        if v < 0:
            continue
        found = {"kind": "node", "block": number, "rep": offset + first, "depth": v, "equal": len(places), "before": sums[first][:v].tolist()}
        found |= side("left", left) | side("right", right) | over(left or 0, m if right is None else right, left is None)
        if left is not None:
            found |= {"end_depth": length[left], "ends": ends[left], "total": total[left]}
        if left is not None and right is not None:
            up = left if lcp[left] >= lcp[right] else right
            found |= {"above": lcp[up], "parent_rep": rep(up), "parent_conv": least_of(up)}
        yield found
    for i in range(m):
        if is_leaf[i]:
            up = i if lcp[i] >= lcp[i + 1] else i + 1
            found = {"kind": "leaf", "block": number, "depth": length[i], "above": max(lcp[i], lcp[i + 1]), "equal": 0, "before": sums[i][: length[i]].tolist()}
            found |= {"end_depth": length[i], "ends": ends[i], "total": total[i], "parent_rep": rep(up), "parent_conv": least_of(up)}
            yield found | over(i, i + 1, False)
    for values, name in ((range(m - 1, -1, -1), "left"), (range(m), "right")):
        low = after if name == "left" else lcp[0]
        for i in values:
            if lcp[i] < low:
                found = {"kind": name, "block": number, "low": lcp[i], "depth": low} | side(name, i)
                found |= over(i, m, False) if name == "left" else over(0, i, True)
                if name == "left":
                    found |= {"end_depth": length[i], "ends": ends[i], "total": total[i]}
                yield found
                low = lcp[i]
    yield {"kind": "block", "block": number, "low": min(lcp[:m])} | over(0, m, True)


def reaches(blocks: Blocks, totals: list[tuple]):
    """A column function of a node's block, depth and known sides: the block that holds its place on each side, and sums over the blocks between.

    ``totals`` has of each block the lowest value and the sums and least id of its rows.
    """
    lows = [t[0] for t in totals]
    before = nearest_smaller(lows)
    after = [len(lows) - 1 - k for k in reversed(nearest_smaller(lows[::-1]))]
    sums = np.concatenate([np.zeros((1, len(SUMS)), dtype=np.int64), np.cumsum(np.array([t[1:-1] for t in totals], dtype=np.int64), axis=0)])
    lowest = RangeMin(np.array([t[-1] for t in totals]))
    index = {b: k for k, b in enumerate(blocks.number)}
    schema = "left_block int, right_block int, right_start long, right_first int, right_inside boolean, " + ", ".join(f"mid_{c} long" for c in [*SUMS, "least"])

    @F.pandas_udf(f"struct<{schema.replace(' ', ':').replace(',:', ',')}>")
    def found(block: pd.Series, depth: pd.Series, has_left: pd.Series, has_right: pd.Series) -> pd.DataFrame:
        out = []
        for b, v, left, right in zip(block, depth, has_left, has_right, strict=True):
            k = index[b]
            i = j = k
            if not left:
                i = k - 1
                while lows[i] >= v:  # the first place of all has -1
                    i = before[i]
            if not right:
                j = k + 1
                while j < len(lows) and lows[j] >= v:
                    j = after[j]
            between = [(i + 1, k)] * (i < k) + [(k + 1, j)] * (j > k)
            mid = sum((sums[b] - sums[a] for a, b in between), np.zeros(len(SUMS), dtype=np.int64)).tolist()
            first = blocks.first[j] if j < len(lows) else -1
            out.append((blocks.number[i], blocks.number[j] if j < len(lows) else -1, blocks.start[j] if j < len(lows) else blocks.rows, first, v <= first, *mid, min([NO_ROWS, *(lowest(*x) for x in between)])))
        return pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    return found


def whole_nodes(local: DataFrame, blocks: Blocks) -> DataFrame:
    """The nodes that reach over borders of blocks, completed: a row for each block's part of it, all with the whole node's figures."""
    totals = {r["block"]: (r["low"], *(r[c] for c in SUMS), r["least"]) for r in local.where("kind = 'block'").select("block", "low", *SUMS, "least").collect()}
    find = reaches(blocks, [totals[b] for b in blocks.number])
    parts = local.where("kind = 'node' AND (left_place IS NULL OR right_place IS NULL)").drop("kind", "above", "parent_rep", "parent_conv", "low")
    parts = parts.withColumn("reach", find("block", "depth", F.col("left_place").isNotNull(), F.col("right_place").isNotNull())).select("*", "reach.*").drop("reach")

    def minima(name: str) -> DataFrame:
        """Suffix or prefix minima of blocks, a row for each value that a place answers: above its own, up to the next one's."""
        kept = [f"{name}_{c}" for c in ("place", "value", "rep")] + (["end_depth", "ends", "total"] if name == "left" else []) + [*SUMS, "least"]
        rows = local.where(F.col("kind") == name).select("block", F.explode(F.sequence(F.col("low") + 1, F.col("depth"))).alias("depth"), *kept)
        return rows.select(*[F.col(c).alias(f"{name[0]}_{c}") for c in rows.columns])

    lefts, rights = minima("left"), minima("right")
    at_left = F.col("left_place").isNull() & (F.col("l_block") == F.col("left_block")) & (F.col("l_depth") == F.col("depth"))
    at_right = F.col("right_place").isNull() & F.col("right_inside") & (F.col("r_block") == F.col("right_block")) & (F.col("r_depth") == F.col("depth"))
    met = parts.join(lefts, at_left, "left").join(rights, at_right, "left")
    own_right = F.col("right_place").isNotNull()
    # a place on the right that is a block's first one needs no search in the block
    right = {
        "right_place": F.coalesce("right_place", "r_right_place", "right_start"),
        "right_value": F.coalesce("right_value", "r_right_value", "right_first"),
        "right_rep": F.when(own_right, F.col("right_rep")).otherwise(F.coalesce("r_right_rep", "right_start")),
    }
    left = {c: F.coalesce(c, f"l_{c}") for c in ("left_place", "left_value", "left_rep", "end_depth", "ends", "total")}
    zero = F.lit(0).cast("long")
    sums = {c: F.col(c) + F.col(f"mid_{c}") + F.coalesce(f"l_{c}", zero) + F.coalesce(f"r_{c}", zero) for c in SUMS}
    least = F.least("least", "mid_least", "l_least", "r_least")
    done = met.select("rep", "depth", "equal", "before", *[x.alias(c) for c, x in (right | left | sums | {"least": least}).items()])
    at_left_parent = F.col("left_value") >= F.col("right_value")
    return done.select(
        "*", F.greatest("left_value", "right_value").alias("above"), F.when(at_left_parent, F.col("left_rep")).otherwise(F.col("right_rep")).alias("parent_rep")
    )


def prefix_trie(whole: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The nodes of the trie of ``whole`` (``conv_id``, ``turns``) with ``COLUMNS``."""
    spark = whole.sparkSession
    groups = saved(distinct_sequences(whole), "sequences")
    n = groups.count()
    if not n:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in COLUMNS))
    cuts = -(-n // max(block_rows, -(-n // MOST_BLOCKS)))
    in_order = groups.repartitionByRange(cuts, "key").sortWithinPartitions("key")
    ordered = saved(in_order.select(F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("row"), "*"), "sorted-sequences")
    blocks = Blocks.of(ordered)

    def local_part(rows: pd.DataFrame) -> pd.DataFrame:
        found = list(of_block(rows, blocks))
        return pd.DataFrame({f: pd.Series([x.get(f) for x in found], dtype=object) for f in FIELDS})

    local = saved(ordered.groupBy("block").applyInPandas(local_part, LOCAL), "block-nodes")
    reaching = saved(whole_nodes(local, blocks), "reaching-nodes")
    kept = ["depth", "above", "equal", "parent_rep", "before", "end_depth", "ends", "total", *SUMS, "least"]
    # each block has a part of such a node: its places of the node's value add up, all else is the same in each
    merged = reaching.groupBy("left_place", "depth").agg(
        F.sum("equal").cast("int").alias("equal"), *[F.min_by(c, "rep").alias(c) for c in kept if c not in ("depth", "equal")]
    ).withColumn("parent_conv", F.lit(None).cast("long")).select(*kept, "parent_conv")
    within = local.where("kind = 'leaf' OR (kind = 'node' AND left_place IS NOT NULL AND right_place IS NOT NULL)").select(*kept, "parent_conv")
    nodes = within.unionByName(merged)
    parents = reaching.select(F.col("rep").alias("parent_rep"), F.col("least").alias("reaching_conv"))
    nodes = nodes.join(parents, "parent_rep", "left")
    return expanded(nodes.withColumn("parent_conv", F.when(F.col("above") >= 0, F.coalesce("parent_conv", "reaching_conv"))))


def expanded(nodes: DataFrame) -> DataFrame:
    """A row for each depth of a node, those between it and its parent included."""
    rows = nodes.withColumn("at", F.explode(F.sequence(F.col("above") + 1, F.col("depth"))))
    is_own, is_top = F.col("at") == F.col("depth"), F.col("at") == F.col("above") + 1
    is_end = is_own & (F.col("end_depth") == F.col("depth"))
    children = F.when(~is_own, 1).when(F.col("equal") == 0, 0).otherwise(F.col("equal") + 1 - F.when(is_end, 1).otherwise(0))
    # texts of the turns above this depth: ``before`` has the sums of the first 0, 1, ... turns
    above = F.when(F.col("at") > 0, F.element_at("before", F.greatest(F.col("at"), F.lit(1)))).otherwise(0)
    spared = F.col("texts") - F.col("fresh") - F.col("total") - (F.col("n") - 1) * above
    columns: list[Column] = [
        F.col("least"), F.col("at"), F.when(is_top, F.col("parent_conv")).otherwise(F.col("least")), F.col("n"), children, F.col("leaves"), spared,
        F.when(is_end, F.col("ends")).otherwise(F.sha2(F.lit(""), 256)),
    ]
    return rows.select(*[(x if c == "ends_sha256" else x.cast("long")).alias(c) for c, x in zip(COLUMNS, columns, strict=True)])


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, list(said ORDER BY turn NULLS FIRST, md5(said)) AS said, list(length(text) ORDER BY turn NULLS FIRST, md5(said)) AS points,
    (xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295) % 6)::BIGINT AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT o.conv_id, list_concat(coalesce(b.said[1:o.h], []), o.said[o.h + 1:]) AS said, list_concat(coalesce(b.points[1:o.h], []), o.points[o.h + 1:]) AS points
  FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100),
m AS (SELECT conv_id, len(said) AS n, unnest(range(len(said) + 1)) AS depth, said, points FROM r),
g AS (
  SELECT said[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(points[depth]), 0) AS points,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM m GROUP BY said[1:depth], depth),
c AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
k AS (SELECT g.*, coalesce(c.n_children, 0) AS n_children FROM g LEFT JOIN c ON c.node = g.node AND c.depth = g.depth),
a AS (SELECT node, unnest(range(depth + 1)) AS top, (n_convs - 1) * points AS spared, n_children FROM k),
s AS (SELECT node[1:top] AS node, top AS depth, sum(spared)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM a GROUP BY ALL)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM k JOIN s ON s.node = k.node AND s.depth = k.depth LEFT JOIN g p ON p.depth = k.depth - 1 AND p.node = k.node[1:k.depth - 1]
"""
