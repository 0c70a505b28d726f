"""Lists on their way out: paths of other systems, copies, order and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def relative(path: Column, root: str) -> Column:
    """What follows the library root, with forward slashes.

    A path outside the root counts from its last folder named like the root's own; null
    where there is none.  A sibling whose name begins like the root is outside.
    """
    base = root.replace("\\", "/").rstrip("/")
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    low, leaf = F.lower(norm), base.lower().rsplit("/", 1)[-1] + "/"
    under = (low == base.lower()) | low.startswith(base.lower() + "/")
    tail = F.length(F.substring_index(low, leaf, -1))
    found = F.when(under, F.substring(norm, F.lit(len(base) + 1), F.length(norm))).when(F.contains(low, F.lit(leaf)), F.right(norm, tail))
    return F.regexp_replace(found, "^/+", "")


def flavoured(path: Column, root: str, kind: str, target: str) -> Column:
    """The path as another system (``unc`` or ``plex``) sees it; null where it cannot be told."""
    if not root or not target:
        return F.lit(None).cast("string")
    tail = relative(path, root)
    if kind == "unc":
        return F.concat(F.lit(target.rstrip("\\/") + "\\"), F.replace(tail, F.lit("/"), F.lit("\\")))
    return F.concat(F.lit(target.rstrip("/") + "/"), tail)


def flavour_report(paths: DataFrame, path: str, root: str, kind: str, target: str) -> DataFrame:
    """One row: the flavour asked for and used, and how many paths kept their local form."""
    kept = F.count_if(flavoured(F.col(path), root, kind, target).isNull())
    used = F.when(F.col("fallback_count") == 0, F.lit(kind)).when(F.col("fallback_count") == F.col("total"), "local").otherwise("mixed")
    out = paths.agg(kept.alias("fallback_count"), F.count(F.lit(1)).alias("total"))
    return out.select(F.lit(kind).alias("requested"), used.alias("used"), (F.col("fallback_count") > 0).alias("fallback"), "fallback_count", "total")


def coverage(paths: DataFrame, path: str, root: str) -> DataFrame:
    return paths.agg(F.count_if(relative(F.col(path), root).isNotNull()).alias("ok"), F.count(F.lit(1)).alias("total"))


def copy_names(items: DataFrame, tree: bool = False) -> DataFrame:
    """``items`` with what the names of their copies are made of besides the ordinal: ``folder``, ``stem`` and ``extension``.

    These depend on the item alone: of a table of items that many lists share, they are made once an item.
    """
    base = text.basename(F.col("path"))
    extension = F.regexp_replace(F.regexp_extract(base, r"(\.[^.]*)$", 1), r'[<>:"/\\|?*\x00-\x1f]', "_")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.regexp_replace(base, r"\.[^.]*$", ""))
    if tree:
        folder, stem = F.concat(text.safe_component(F.col("artist"), "Unknown Artist"), F.lit("/"), text.safe_component(F.coalesce(F.nullif(F.col("album"), F.lit("")), F.lit("Unknown Album")), "Unknown Album"), F.lit("/")), title
    else:
        label = F.btrim(F.concat(F.coalesce("artist", F.lit("")), F.lit(" - "), title), F.lit(" -"))
        folder, stem = F.lit(""), text.safe_component(F.coalesce(F.nullif(label, F.lit("")), title), "track")
    return items.withColumns({"folder": folder, "stem": stem, "extension": extension})


def copy_plan(items: DataFrame, tree: bool = False) -> DataFrame:
    """``playlist``, ``ordinal``, ``path`` and the relative ``name`` of each copy, over lists with a ``position``; ``items`` as of ``copy_names``.

    Names begin with their ordinal, at least two digits wide and as wide as the list's
    length, so that none recurs in a list, and are safe for file systems with few allowed
    characters.
    """
    one = Window.partitionBy("playlist").orderBy("position", "path")
    rows = items.withColumn("ordinal", F.row_number().over(one)).withColumn("width", F.greatest(F.lit(2), F.length(F.count(F.lit(1)).over(Window.partitionBy("playlist")).cast("string"))))
    named = F.concat_ws(" ", F.lpad(F.col("ordinal").cast("string"), F.col("width"), F.lit("0")), F.col("stem"))
    return rows.select("playlist", "ordinal", "path", F.concat("folder", text.safe_component(named) if tree else named, "extension").alias("name"))


def in_order(wanted: Column, existing: Column) -> Column:
    """The wanted items, then what else is there."""
    return F.concat(wanted, F.filter(existing, lambda x: ~F.array_contains(wanted, x)))


def same_order(wanted: Column, existing: Column) -> Column:
    """Whether the items that both have come in one order."""
    return F.filter(wanted, lambda x: F.array_contains(existing, x)) == F.filter(existing, lambda x: F.array_contains(wanted, x))


def changes(wanted: DataFrame, existing: DataFrame, keys: list[str], prune: bool = False) -> DataFrame:
    """What to ``add`` to, and with ``prune`` to ``remove`` from, the stored lists."""
    out = wanted.join(existing, keys, "left_anti").select(*keys, F.lit("add").alias("action"))
    return out.unionByName(existing.join(wanted, keys, "left_anti").select(*keys, F.lit("remove").alias("action"))) if prune else out


#: Fixed values of the generator that shuffles lists: multiplier and modulus.
MULTIPLIER, MODULUS = 48271, 2147483647


def shuffled(items: Column, seed: Column) -> Column:
    """A list in an order that depends on its length and the seed only (Fisher-Yates from the end)."""
    swap = lambda a, i, j: F.transform(a, lambda x, k: F.when(k == i, F.element_at(a, j + 1)).when(k == j, F.element_at(a, i + 1)).otherwise(x))
    first = F.struct(items.alias("a"), F.when(seed == 0, F.lit(1)).otherwise(seed).bitwiseAND(MODULUS).cast("long").alias("s"))
    # a list of one has no step: sequence() would count the wrong way
    steps = F.when(F.size(items) > 1, F.reverse(F.sequence(F.lit(1), F.size(items) - 1))).otherwise(F.array().cast("array<int>"))

    def step(state: Column, i: Column) -> Column:
        s = F.pmod(state["s"] * MULTIPLIER, F.lit(MODULUS))
        j = F.pmod(s, i + 1).cast("int")
        return F.struct(swap(state["a"], i, j).alias("a"), s.cast("long").alias("s"))

    return F.aggregate(steps, first, step)["a"]
