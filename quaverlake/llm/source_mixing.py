"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) weigh 1, 2, 3, repeating.  Targets share
the total size by weight, and stop at ``max_repeat`` times their source's size;
the excess is shared again by weight until no target is above.  That is
``min(cap, weight * level)`` with one level for all open sources, found in closed
form from the sources sorted by ``cap / weight``.

Within a source each document expects ``rate = target / source size`` copies.
The expected copies are prefix-summed in order of size class, add one random
offset of the source, and a document is emitted once for each integer boundary
crossed.  Size classes (an eighth of a power of two) keep the words taken within
a few documents of the target.

A source may hold most rows, so its prefix sum has three levels: rows are numbered
within blocks, into which a hash of id and size deals the rows of a (source, size
class) of many, and counts of blocks within their class and of classes within their
source, one small row each, are summed ahead of them.  A block has about
``BLOCK_ROWS`` rows, or the ``MOST_BLOCKS``-th part of all if that is more.

Defined cases: null text has size 0; documents of size 0 are numbered like the
others, and take 0 words; a source whose sizes are all 0 has target 0 and no
copies; null ids sort first; repeated rows count separately, and are told apart
only by their number; an empty table gives an empty result.  Input columns named
like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, saved, table

RESULTS = ("size", "source_size", "target", "taken")
WEIGHT_CYCLE = 3
BLOCK_ROWS = 2048
MOST_BLOCKS = 20000
BLOCK = ["__source", "__class", "__block"]


def source_key(source: Column) -> Column:
    """A key without nulls that sorts as the source does, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sized: DataFrame, max_repeat: int) -> DataFrame:
    """One row per source: ``__source_size``, ``__target``, ``__rate`` and ``__offset``."""
    # the windows below run over this table only, one row a source
    sources = sized.groupBy("__source").agg(F.sum("__size").alias("__source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    number = F.row_number().over(Window.orderBy("__source"))
    weighed = sources.withColumn("__weight", F.pmod(number - 1, F.lit(WEIGHT_CYCLE)) + 1).withColumn("__cap", F.col("__source_size") * max_repeat)
    edged = weighed.withColumn("__edge", F.col("__cap") / F.col("__weight"))
    by_edge = Window.orderBy("__edge", "__source")
    before, onward = by_edge.rowsBetween(Window.unboundedPreceding, -1), by_edge.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("__source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    levels = edged.withColumn("__level", left / F.sum("__weight").over(onward))
    # the first source by edge that stays under its cap sets the level of all open ones
    opened = F.when(F.col("__edge") >= F.col("__level"), F.struct("__edge", "__level"))
    target = F.least(F.col("__cap").cast("double"), F.col("__weight") * F.min(opened).over(everything)["__level"])
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.col("__source"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return levels.withColumn("__target", target).select(
        "__source",
        "__source_size",
        "__target",
        F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0)).alias("__rate"),
        draw.alias("__offset"),
    )


def class_blocks(slim: DataFrame) -> DataFrame:
    """The (source, class) pairs of more than one block, with their ``__blocks``: fewer than ``MOST_BLOCKS``."""
    most = max(BLOCK_ROWS, slim.count() // MOST_BLOCKS)
    counts = slim.groupBy("__source", "__class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return saved(counts.select("__source", "__class", F.ceil(F.col("n") / most).alias("__blocks")), "blocks")


def in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` with their ``__block``: a hash of id and size, modulo the blocks of the class."""
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("__id").cast("string"), F.col("__size").cast("string"))), 1, 8), 16, 10).cast("long")
    met = rows.join(F.broadcast(blocks), ["__source", "__class"], "left")
    return met.withColumn("__block", F.pmod(digest, F.coalesce("__blocks", F.lit(1)))).drop("__blocks")


def block_starts(slim: DataFrame, max_repeat: int) -> DataFrame:
    """One row per block: the rows of its source ahead of it, and its source's figures."""
    counts = slim.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("__rows"))
    previous = (Window.unboundedPreceding, -1)
    # prefix sums of blocks within a class, and of classes within a source: a source has a few hundred classes
    in_class = Window.partitionBy("__source", "__class").orderBy("__block").rowsBetween(*previous)
    in_source = Window.partitionBy("__source").orderBy("__class").rowsBetween(*previous)
    classes = counts.groupBy("__source", "__class").agg(F.sum("__rows").alias("__class_rows"))
    classes = classes.withColumn("__classes_ahead", F.coalesce(F.sum("__class_rows").over(in_source), F.lit(0))).drop("__class_rows")
    summed = counts.withColumn("__blocks_ahead", F.coalesce(F.sum("__rows").over(in_class), F.lit(0))).join(classes, ["__source", "__class"])
    summed = summed.select(*BLOCK, (F.col("__blocks_ahead") + F.col("__classes_ahead")).alias("__ahead"))
    return summed.join(source_targets(slim, max_repeat), "__source")


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeat: int = 3, size_col: str | None = None
) -> DataFrame:
    """All rows with their size, their source's size and target, and the words taken.

    ``__copies``, the times that the mix emits the row, comes along.  ``size_col``
    names a column that already holds the sizes.
    """
    size = F.col(size_col).cast("long") if size_col else word_count(F.col(text_col))
    bit_class = F.expr("cast(length(bin(__size)) * 8 + (shiftright(__size, greatest(length(bin(__size)) - 4, 0)) & 7) as int)")
    base = df.withColumns({"__size": size, "__source": source_key(F.col(source_col)), "__id": F.coalesce(F.col(id_col), F.lit(0))})
    base = base.withColumn("__class", bit_class)
    slim = base.select("__source", "__class", "__size", "__id")
    slim = slim if size_col else cut(slim)
    blocks = class_blocks(slim)
    within = Window.partitionBy(*BLOCK).orderBy("__size", F.col(id_col).asc_nulls_first())
    numbered = in_blocks(base, blocks).withColumn("__row", F.row_number().over(within))
    joined = numbered.join(block_starts(in_blocks(slim, blocks), max_repeat), BLOCK)

    def reached(rows: Column) -> Column:
        return F.floor(F.col("__rate") * rows + F.col("__offset"))

    rank = F.col("__row") + F.col("__ahead")
    kept = [c for c in df.columns if c not in RESULTS]
    return joined.withColumn("__copies", (reached(rank) - reached(rank - 1)).cast("int")).select(
        *kept,
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
        "__copies",
    )


def emit_mix(df: DataFrame, **kw) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the input's columns."""
    wrapped = df.withColumnsRenamed({c: f"in__{c}" for c in df.columns})
    names = {k: f"in__{kw.pop(k, d)}" for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    taken = mix_sources(wrapped, **names, **kw).where("__copies > 0")
    copied = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return copied.select(*[F.col(f"in__{c}").alias(c) for c in df.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # sizes are small next to texts: count words once and keep them in the shared folder
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")))
    return mix_sources(sized, size_col="words").select("doc_id", *RESULTS)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (SELECT *, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) AS class FROM d),
c AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id, 0) || ':' || size), 1, 8))::BIGINT
         % ceil(count(*) OVER (PARTITION BY source, class) / greatest(2048, (SELECT count(*) FROM d) // 20000)::DOUBLE)::BIGINT AS block
  FROM k),
w AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::BIGINT * 3 AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, cap / weight AS edge,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size,
         least(cap::DOUBLE, weight * (SELECT arg_min(level, edge) FROM l WHERE edge >= level)) AS target,
         ('0x' || substr(md5('mix:' || coalesce('0' || source, '1')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS offs
  FROM l),
r AS (
  SELECT doc_id, size, source, row_number() OVER (PARTITION BY source ORDER BY class, block, size, doc_id NULLS FIRST) AS n FROM c)
SELECT doc_id, size, source_size, target,
       size * (floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END * n + offs)
             - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END * (n - 1) + offs))::BIGINT AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""
