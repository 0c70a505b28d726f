"""Exact dedup: two-pass Bloom filtering, DataFrame functions only.

Pass one hashes every normalised text to ``PROBES`` positions of a bit array
and keeps the positions that two or more rows hit: a counting Bloom filter cut
off at two.  Pass two tests every row.  A hash that occurs twice has all its
positions in the filter, so a row with a position outside it is unique and
passes straight through; only the other rows shuffle, to be grouped by the
SHA-256 of their text; the rows of a large group are dealt by id instead.  False
positives cost a shuffled row, never a wrong result.

The filter has 32 bits a row, as 4 KB bitmaps.  Up to ``max_filter_bits`` (32 MB by
default) they are broadcast; a larger filter is joined by the range of hashes that a
bitmap holds, where the few ranges that very many rows hit are dealt by id.

Defined cases: a null text counts as empty; rows with a null id come after all
others when a keeper is chosen; rows that repeat both id and text are the same
document and share its decision (``keep_distinct`` returns it once); an empty
table gives an empty result; input columns named like a result column are
replaced by it in ``annotate_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut, join_groups, table

PROBES = 2
#: Bits of one bitmap of the bitmap functions.
BITMAP_BITS = 32768


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")


def filter_bits(rows: int) -> int:
    """A power of two, 32 bits a row or more."""
    return max(BITMAP_BITS, 1 << max(1, 32 * rows).bit_length())


def _probe(digest: str, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(digest), F.lit(k)), F.lit(bits))


def repeat_filter(digests: DataFrame, digest: str, bits: int) -> DataFrame:
    """Bitmaps of the positions that two or more rows hit, at most ``bits / 8`` bytes, with the hits of each (``__rows``)."""
    hit = (
        digests.select(F.explode(F.array(*[_probe(digest, k, bits) for k in range(PROBES)])).alias("__pos"))
        .groupBy("__pos").agg(F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
    )
    return hit.groupBy(F.shiftright("__pos", 15).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.col("__pos").bitwiseAND(BITMAP_BITS - 1)).alias("__bits"), F.sum("__n").alias("__rows")
    )


def mark_possible_repeats(rows: DataFrame, id_col: str, digest: str, bits: int, bitmaps: DataFrame, broadcast: bool, total: int) -> DataFrame:
    """Adds ``__maybe``: true where all positions of the row's hash are in the filter.

    Each bitmap is tested right after its join, so that no row takes one along.
    """
    out = rows.withColumn("__maybe", F.lit(True))
    for k in range(PROBES):
        side = bitmaps.select(F.col("__bucket").alias(f"__bucket{k}"), F.col("__bits").alias(f"__bits{k}"), "__rows")
        out = out.withColumn(f"__pos{k}", _probe(digest, k, bits))
        if broadcast:
            out = out.join(F.broadcast(side.drop("__rows")), F.shiftright(f"__pos{k}", 15) == F.col(f"__bucket{k}"), "left")
        else:
            out = join_groups(out.withColumn(f"__bucket{k}", F.shiftright(f"__pos{k}", 15)), side, f"__bucket{k}", PROBES * total, F.col(id_col))
        test = F.expr(
            f"coalesce(shiftright(cast(conv(hex(substring(__bits{k}, cast(shiftright(__pos{k} & 32767, 3) + 1 AS INT), 1)), 16, 10) AS INT),"
            f" cast(__pos{k} & 7 AS INT)) & 1 = 1, false)"
        )
        out = out.withColumn("__maybe", F.col("__maybe") & test).drop(f"__pos{k}", f"__bucket{k}", f"__bits{k}")
    return out


def group_by_digest(rows: DataFrame, id_col: str, digest: str, max_filter_bits: int, slim: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``__keep_id`` and ``__group_size``.  ``slim`` has the ids and digests of ``rows``, where these are costly."""
    slim = rows.select(id_col, digest) if slim is None else slim
    total = slim.count()
    bits = filter_bits(total)
    bitmaps = cut(repeat_filter(slim.select(digest), digest, bits))

    def split(df: DataFrame) -> list[DataFrame]:
        tested = mark_possible_repeats(df, id_col, digest, bits, bitmaps, bits <= max_filter_bits, total)
        return [tested.where(x).drop("__maybe") for x in ("__maybe", "NOT __maybe")]

    maybe, unique = split(rows)
    # min() skips null ids, so a null id is kept only where the group has no other
    groups = split(slim)[0].groupBy(digest).agg(F.min(id_col).alias("__keep_id"), F.count(F.lit(1)).alias("__group_size")).withColumn("__rows", F.col("__group_size"))
    grouped = join_groups(maybe, groups, digest, total, F.col(id_col))
    passed = unique.withColumns({"__keep_id": F.col(id_col), "__group_size": F.lit(1).cast("long")})
    return grouped.unionByName(passed)


def annotate_digests(rows: DataFrame, id_col: str = "doc_id", digest: str = "text_sha256", max_filter_bits: int = 1 << 28) -> DataFrame:
    """``rows`` with ``keep_id``, ``group_size`` and ``kept``, from their digest column."""
    clash = [c for c in ("keep_id", "group_size", "kept") if c in rows.columns]
    found = group_by_digest(rows.drop(*clash), id_col, digest, max_filter_bits)
    return found.withColumn("kept", F.col("__keep_id").eqNullSafe(F.col(id_col))).withColumnsRenamed(
        {"__keep_id": "keep_id", "__group_size": "group_size"}
    )


def annotate_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = 1 << 28) -> DataFrame:
    """All rows with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    rows = df.withColumn("text_sha256", F.sha2(normalised(F.col(text_col)), 256))
    return annotate_digests(rows, id_col, "text_sha256", max_filter_bits)


def keep_distinct(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = 1 << 28) -> DataFrame:
    """One row of each group of equal texts, with the input's own columns."""
    rows = df.withColumn("__sha", F.sha2(normalised(F.col(text_col)), 256))
    found = group_by_digest(rows, id_col, "__sha", max_filter_bits, cut(rows.select(id_col, "__sha")))
    single = found.where("__group_size = 1")
    # a keeper is one row but where id and text repeat; such copies collapse by digest
    several = found.where(F.col("__keep_id").eqNullSafe(F.col(id_col)) & (F.col("__group_size") > 1)).dropDuplicates(["__sha"])
    return single.unionByName(several).select(df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # digests are small next to texts: hash once and keep them in the shared folder
    digests = cut(docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256")))
    return annotate_digests(digests).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
