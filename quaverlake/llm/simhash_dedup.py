"""SimHash near-dedup with pigeonring filtering.

A fingerprint has a bit set where over half of the XXH64 hashes of the text's word
shingles have it.  Fingerprints within ``distance`` bits link, and linked ones form
groups.

The 64 bits lie on a ring of ``segments`` pieces.  By the pigeonring principle, two
fingerprints within ``distance`` bits have a start such that each chain of ``l``
consecutive pieces from it differs in at most ``l * distance / segments`` bits.
With 5 pieces and 2 bits, the first two pieces of the chain are equal: these about
26 bits are a join key, at five starts; chains of three and four pieces then allow
one bit, which is checked before the whole distance.

Equal fingerprints are one class from the start.  Keys that few classes share are
joined; for a key with more than ``max_bucket`` classes the classes are dealt into
blocks, and each pair of blocks is compared in one task, by the same chains, that
returns a forest of the links it finds, never all pairs.  The work on such a key
grows as the square of its distinct fingerprints, which share 26 bits of 64.

``keep_one_per_group`` is for near copies by Jaccard similarity of word shingles.
There, a text has several fingerprints, each over a consistent sample of its
shingles; texts whose fingerprints link are compared shingle by shingle.

Defined cases: null text is like empty text; no words gives fingerprint zero,
linked like any other; fewer words than a shingle give one shingle of them all;
very long texts are hashed whole; ties do not arise, as groups are named by their
least id; rows with a null id have a group but never name it unless all its ids are
null; rows that repeat an id are compared like others; an empty table gives an empty
result; input columns besides id and text are dropped by ``group_documents``, and
kept by ``keep_one_per_group``, which uses names with two leading underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, join_dealt, join_groups, new_folder, saved, small_batches, table
from .graph import connected_components, forest

SEED = 42
BITS = 64


# --- fingerprints ------------------------------------------------------------


def shingles_of(text: str | None, shingle: int) -> np.ndarray:
    """The unsigned hashes of a text's word shingles, repeats included.  Words lie between ASCII white space; A-Z are lowered."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    whole = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, whole, repeat(SEED)), dtype="<u8")


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of each row of hashes, the bits that are set in over half, as one number."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(*hashes.shape, 8), axis=-1, bitorder="little")
    return np.packbits(2 * bits.sum(axis=-2, dtype=np.int64) > hashes.shape[-1], axis=-1, bitorder="little").view("<u8")[..., 0]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    hashes = shingles_of(text, shingle)
    return int(majority(hashes)) if len(hashes) else 0


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """Fingerprints as signed 64-bit integers."""

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(x, shingle) for x in batch], dtype=np.uint64).view(np.int64))

    return hashed(text)


# --- pigeonring ----------------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def ring(segments: int) -> list[int]:
    """Bit masks of the pieces, as even as can be."""
    edges = [BITS * k // segments for k in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def chains(segments: int, distance: int) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """For each start: the mask of the chain that must be equal, and (mask, most bits) of longer ones."""
    pieces, exact, longer = ring(segments), [], []
    for start in range(segments):
        mask, equal, more = 0, 0, []
        for length in range(1, segments):
            mask |= pieces[(start + length - 1) % segments]
            allowed = length * distance // segments
            if allowed == 0:
                equal = mask
            else:
                more.append((mask, allowed))
        exact.append(equal)
        longer.append(more)
    return exact, longer


def _near_in_block(key: tuple, rows: pd.DataFrame, longer: list[list[tuple[int, int]]], distance: int) -> pd.DataFrame:
    """A forest of the links among the rows of one block, or between those of two."""
    start, a, b = int(rows["start"].iloc[0]), *key[-2:]
    fp = rows["fp"].to_numpy().view(np.uint64)
    one, other = np.flatnonzero(rows["block"] == a), np.flatnonzero(rows["block"] == b)
    tests = [*((np.uint64(mask), most) for mask, most in longer[start]), (np.uint64((1 << BITS) - 1), distance)]

    def links():
        for k, i in enumerate(one):
            near = other[k + 1 :] if a == b else other
            for mask, most in tests:
                near = near[np.bitwise_count((fp[near] ^ fp[i]) & mask) <= most]
            if len(near):
                yield int(i), near

    name, kept = rows["name"].to_numpy(), np.array(forest(len(fp), links()), dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": name[kept[:, 0]], "b": name[kept[:, 1]]})


def near_pairs(classes: DataFrame, distance: int = 2, segments: int = 5, max_bucket: int = 64, block: int = 4096) -> DataFrame:
    """Links (``a``, ``b``) between fingerprints (column ``fp``, distinct) that connect all that are within ``distance`` bits.

    Where there are columns ``name`` and ``family``, links are between names, of
    fingerprints of one family.
    """
    if segments <= distance:
        raise ValueError("the ring needs more pieces than the distance has bits")
    if "name" not in classes.columns:
        classes = classes.select(F.col("fp").alias("name"), "fp", F.lit(0).alias("family"))
    exact, longer = chains(segments, distance)
    starts = F.array(*[F.struct(F.lit(k).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("chain")) for k, m in enumerate(exact)])
    keyed = classes.select("name", "fp", "family", F.explode(starts).alias("at")).select("name", "fp", "at.start", F.xxhash64("family", "at.start", "at.chain").alias("key"))
    # most keys have one fingerprint: the few others are a small table, which a join can broadcast
    sizes = saved(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "ring-keys")
    shared = saved(keyed.join(sizes, "key"), "ring-rows")
    left, right = (shared.where(F.col("size") <= max_bucket).select("key", "start", *[F.col(c).alias(f"{x}_{c}") for c in ("name", "fp")]) for x in "ab")
    differ, passes = F.col("a_fp").bitwiseXOR(F.col("b_fp")), F.lit(True)
    for length in range(len(longer[0])):
        masks = F.array(*[F.lit(_signed(longer[k][length][0])) for k in range(segments)])
        passes = passes & (F.bit_count(differ.bitwiseAND(F.element_at(masks, F.col("start") + 1))) <= longer[0][length][1])
    pairs = left.join(right.drop("start"), "key").where((F.col("a_name") < F.col("b_name")) & passes & (F.bit_count(differ) <= distance))
    pairs = pairs.select(F.col("a_name").alias("a"), F.col("b_name").alias("b"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    large = shared.where(F.col("size") > max_bucket).withColumn("block", F.pmod(F.xxhash64("name", "start"), blocks).cast("int"))
    dealt = large.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    grouped = dealt.select("key", "start", "name", "fp", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    found = grouped.groupBy("key", "one", "two").applyInPandas(lambda key, rows: _near_in_block(key, rows, longer, distance), "a long, b long")
    return pairs.unionByName(found)


def group_documents(hashed: DataFrame, id_col: str = "doc_id", distance: int = 2, segments: int = 5) -> DataFrame:
    """``hashed`` (an id and ``fp``) with ``component_id``, the least id of its group."""
    classes = cut(hashed.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("__rows")))
    links = near_pairs(classes.select("fp"), distance, segments)
    members = connected_components(links).select(F.col("node").alias("fp"), "root")
    linked = cut(members.join(classes, "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(least, "root").select("fp", "component")
    ids = classes.join(named, "fp", "left").select("fp", "__rows", F.coalesce("component", "least").alias("component_id"))
    total = classes.agg(F.sum("__rows")).first()[0] or 0
    return join_groups(hashed, ids, "fp", total, F.col(id_col))


def hash_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Ids and fingerprints, kept in the shared folder."""
    return cut(df.select(id_col, fingerprints(F.col(text_col), shingle).alias("fp")))


# --- near copies by Jaccard similarity -------------------------------------------

#: Fingerprints of a text for near copies, and the shingles that each one samples.
#: A pair of similarity s has no equal ones with a probability of (1 - s^SAMPLE)^FAMILIES: 0.003 at 0.8.
#: An odd number, or a bit would be set in less than half of all fingerprints.
FAMILIES, SAMPLE = 8, 3
#: Orders in which samples take the least: odd multipliers of 64-bit hashes.
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, FAMILIES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
INVERSES = np.array([pow(int(m), -1, 1 << BITS) for m in MULTIPLIERS], dtype=np.uint64)
#: Fixed value: an odd number near 2^64 over the golden ratio.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A set's hashes by their low byte, each bit the parity of a count: two sets differ in at least as many members as bits.
PARITY = ["p0", "p1", "p2", "p3"]
#: What rows of nodes carry, so that pairs that surely fall below the similarity are not made.
CARRIED = ["n", *PARITY]
#: Most members whose numbers order the others; any order gives the same links.
COMMON = 1 << 16


#: Long texts go in pieces of about so many bytes.
PIECE = 1 << 18
#: Random values of bytes, and powers of an odd number and of its inverse for their places.
BYTE_VALUES = np.random.default_rng(SEED + 1).integers(0, 1 << 63, 256, dtype=np.uint64)
POWERS, UNPOWERS = (np.cumprod(np.full(PIECE, x, dtype=np.uint64)) for x in (int(MULTIPLIERS[0]), int(INVERSES[0])))
IN_WORD = np.ones(256, dtype=np.int8)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = 0


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit polynomial hash of each word, in order.  Words lie between ASCII white space; A-Z are lowered."""
    data, out, at = np.frombuffer((text or "").encode("utf-8", "replace").lower(), dtype=np.uint8), [], 0
    while at < len(data):
        here = IN_WORD[data[at : at + PIECE]]
        if at + PIECE < len(data) and here[-1]:
            if here.all():
                one, at = long_word_hash(data, at)
                out.append(one)
                continue
            here = here[: len(here) - int(here[::-1].argmin())]
        inside = np.zeros(len(here) + 2, dtype=np.int8)
        inside[1:-1] = here
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(here) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data[at : at + len(here)]] * POWERS[: len(here)], out=sums[1:])
        hashes = ((sums[ends] - sums[starts]) * UNPOWERS[starts]) if len(starts) else np.empty(0, dtype=np.uint64)
        out.append((hashes ^ (hashes >> np.uint64(32))) * MIX)
        at += len(here)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def long_word_hash(data: np.ndarray, at: int) -> tuple[np.ndarray, int]:
    """The hash of the word at a place, longer than a piece, and the place of its end: the sum goes on from piece to piece."""
    total, scale = np.zeros(1, dtype=np.uint64), UNPOWERS[:1]
    while at < len(data):
        here = IN_WORD[data[at : at + PIECE]]
        n = len(here) if here.all() else int(here.argmin())
        total += np.sum(BYTE_VALUES[data[at : at + n]] * POWERS[:n], dtype=np.uint64) * scale
        scale, at = scale * POWERS[-1:], at + n
        if n < PIECE:
            break
    return (total ^ (total >> np.uint64(32))) * MIX, at


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending: each mixed from those of its words in order.

    Fewer words than a shingle are one of them all, and so is no word.
    """
    words = word_hashes(text)
    size = min(shingle, len(words))
    mixed = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        mixed ^= words[k : k + len(mixed)]
        mixed *= MIX
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.append(True, mixed[1:] != mixed[:-1])]


def sampled_fingerprints(members: np.ndarray) -> np.ndarray:
    """A fingerprint for each family: over the ``SAMPLE`` members that come first in its order, or all of fewer."""
    least = np.empty((FAMILIES, 0), dtype=np.uint64)
    for k in range(0, len(members), 1 << 15):
        least = np.concatenate([least, MULTIPLIERS[:, None] * members[None, k : k + (1 << 15)]], axis=1)
        if least.shape[1] > SAMPLE:
            least = np.partition(least, SAMPLE - 1, axis=1)[:, :SAMPLE]
    return majority(least * INVERSES[:, None])


def sketches(text: Column, shingle: int) -> Column:
    """What stands for a text until it is compared: of its shingle set a digest (``node``), size, parities and sampled fingerprints."""

    @F.pandas_udf("struct<node:long,n:long,p0:long,p1:long,p2:long,p3:long,fps:array<long>>")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch:
                members = shingle_set(x, shingle)
                odd = np.packbits(np.bincount((members & np.uint64(255)).astype(np.int64), minlength=256) & 1, bitorder="little").view(np.int64)
                out.append((_signed(xxhash.xxh64_intdigest(members.tobytes(), SEED)), len(members), *odd.tolist(), sampled_fingerprints(members).view(np.int64)))
            yield pd.DataFrame(out, columns=["node", "n", *PARITY, "fps"])

    return sketched(text)


def shingle_hashes(text: Column, shingle: int) -> Column:
    """The distinct hashes of a text's word shingles."""

    @F.pandas_udf("array<long>")
    def hashed(batch: pd.Series) -> pd.Series:
        return batch.map(lambda text: shingle_set(text, shingle).view(np.int64))

    return hashed(text)


def _may_reach(similarity: float) -> Column:
    """False only where the sets of ``a_`` and ``b_`` columns surely have a lower Jaccard similarity."""
    least, most = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    differ = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITY), F.lit(0))
    bound = (1 - similarity) / (1 + similarity) * (F.col("a_n") + F.col("b_n")) + 1e-6
    return (least + 1e-6 >= similarity * most) & (differ <= bound)


class NearCopies:
    """The texts of a table of near copies to be, each distinct shingle set a node, and checks of links between them."""

    def __init__(self, ids: DataFrame, shingle: int, similarity: float):
        """``ids`` has ``__id`` (not null), ``__text`` and ``__mark``, which tells texts of one id apart."""
        self.ids, self.shingle, self.similarity = ids, shingle, similarity
        with small_batches(ids.sparkSession):
            self.rows = saved(ids.select("__id", "__mark", sketches(F.col("__text"), shingle).alias("s")).select("__id", "__mark", "s.*"), "sketches")
        same = [F.first(c).alias(c) for c in ("n", *PARITY, "fps")]
        self.nodes = saved(self.rows.groupBy("node").agg(*same, F.min(F.struct("__id", "__mark")).alias("least"), F.count(F.lit(1)).alias("__rows")), "nodes")

    def with_sides(self, links: DataFrame, side: DataFrame, total: int) -> DataFrame:
        """``links`` (``total``) with the columns of ``side`` (``node`` and others) for both ends; an end may have most links."""
        for end, other in ("ab", "ba"):
            named = side.select(*[F.col(c).alias(end if c == "node" else f"{end}_{c}") for c in side.columns])
            counts = links.groupBy(end).agg(F.count(F.lit(1)).alias("__rows"))
            links = join_dealt(links, named, end, counts, total, F.col(other))
        return links

    def sets(self, wanted: DataFrame, path: str | None = None) -> DataFrame:
        """``node`` and ``set`` of some nodes, from the texts."""
        chosen = saved(self.nodes.select("node", "least.__id", "least.__mark").join(wanted.distinct(), "node"), "wanted")
        found = self.ids.join(chosen, ["__id", "__mark"]).select("node", shingle_hashes(F.col("__text"), self.shingle).alias("set"))
        with small_batches(found.sparkSession):
            return saved(found.dropDuplicates(["node"]), "sets", path)

    def verified(self, links: DataFrame) -> DataFrame:
        """Those of the links (``a``, ``b``) whose sets have the similarity."""
        spark = links.sparkSession
        used = [new_folder(spark, label) for label in ("candidates", "sets")]
        hopeful = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "candidates", used[0])
        total = hopeful.count()
        if total == 0:
            return hopeful
        sets = self.sets(hopeful.select(F.col("a").alias("node")).unionByName(hopeful.select(F.col("b").alias("node"))), used[1])
        both = F.size(F.array_intersect("a_set", "b_set"))
        either = F.size("a_set") + F.size("b_set") - both
        found = saved(self.with_sides(hopeful, sets, total).where(both >= self.similarity * either).select("a", "b"), "links")
        discard(spark, *used)
        return found

    def buckets(self, distance: int, segments: int, max_bucket: int) -> DataFrame:
        """``node``, what it carries, ``bucket`` and its ``size``: nodes of a bucket have fingerprints of one family that link; only buckets of several."""
        marks = self.nodes.select("node", *CARRIED, F.posexplode("fps").alias("family", "fp")).withColumn("name", F.xxhash64("family", "fp"))
        classes = saved(marks.groupBy("name").agg(F.first("family").alias("family"), F.first("fp").alias("fp"), F.count(F.lit(1)).alias("n")), "classes")
        near = saved(near_pairs(classes, distance, segments, max_bucket), "near")
        linked = saved(connected_components(near), "linked") if not near.isEmpty() else near.select(F.col("a").alias("node"), F.col("b").alias("root"))
        named = classes.join(linked.select(F.col("node").alias("name"), "root"), "name", "left").select("name", "n", F.coalesce("root", "name").alias("bucket"))
        sizes = named.groupBy("bucket").agg(F.sum("n").alias("size")).where("size > 1")
        shared = saved(named.join(sizes, "bucket").select("name", "bucket", "size", F.col("n").alias("__rows")), "buckets")
        found = join_groups(marks.select("node", "name", *CARRIED), shared, "name", max(1, FAMILIES * self.nodes.count()), F.col("node"))
        return saved(found.where("bucket IS NOT NULL").select("node", "bucket", "size", *CARRIED).distinct(), "members")

    def to_hubs(self, members: DataFrame, turn: int, total: int) -> DataFrame:
        """A link from each node of a bucket to its hub, where their parts differ; ``members`` has at most ``total`` rows.

        The first hub is the node whose buckets are the largest, of which most copies
        were made; later ones are any, by a hash of the ``turn``.
        """
        if turn == 0:
            seats = members.groupBy("node").agg(F.sum("size").alias("score"), F.collect_list(F.struct("bucket", "size", "part", *CARRIED)).alias("at"))
            scored = seats.select("node", "score", F.explode("at").alias("x")).select("node", "score", "x.*")
        else:
            scored = members.withColumn("score", F.xxhash64("node", F.lit(turn)))
        hubs = scored.groupBy("bucket").agg(F.max(F.struct("score", "node", "part", *CARRIED)).alias("hub"), F.max("size").alias("__rows"))
        met = join_groups(members, hubs, "bucket", total, F.col("node")).where("part <> hub.part")
        pairs = met.select(F.col("node").alias("a"), F.col("hub.node").alias("b"), *[F.col(c).alias(f"a_{c}") for c in CARRIED], *[F.col(f"hub.{c}").alias(f"b_{c}") for c in CARRIED])
        return pairs.where(_may_reach(self.similarity)).select("a", "b")

    def apart(self, members: DataFrame, roots: DataFrame, total: int) -> DataFrame:
        """``members`` (``total``) with their ``part``, of buckets that have several."""
        parts = roots.select("node", F.col("root").alias("part"))
        found = saved(members.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "parts")
        mixed = found.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max("size").alias("__rows")).where("low <> high").drop("high")
        return saved(join_groups(found, mixed, "bucket", total, F.col("node")).where("low IS NOT NULL").drop("low"), "apart")

    def across(self, rows: DataFrame, key: str, block: int = 4096) -> DataFrame:
        """Links between ``rows`` (``node``, what it carries, ``part``, ``key``) of one key and different parts, but for those that surely fall below the similarity."""
        counts = rows.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"))
        tops = counts.groupBy(key).agg(F.max(F.struct("n", "part"))["part"].alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("__rows")).where("parts > 1")
        tops = saved(tops.withColumn("blocks", F.ceil(F.col("__rows") / block).cast("int")).drop("parts"), "tops")
        met = saved(join_groups(rows, tops, key, rows.count(), F.col("node")).where("top IS NOT NULL"), "across")
        left = met.where("part <> top").select(key, F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("block"), *[F.col(c).alias(f"a_{c}") for c in ("node", "part", *CARRIED)])
        right = met.select(key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"b_{c}") for c in ("node", "part", *CARRIED)])
        met = left.join(right, [key, "block"]).where((F.col("a_part") != F.col("b_part")) & _may_reach(self.similarity))
        return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))

    def around_hubs(self, members: DataFrame) -> DataFrame:
        """The nodes of ``members`` (buckets that meet are taken together) but hubs: with their hub, its size and part, and ``delta``, the members that only one of both sets has."""
        seats = members.groupBy("node").agg(F.sum("size").alias("score"), *[F.first(c).alias(c) for c in ("part", *CARRIED)])
        meeting = connected_components(members.select(F.col("node").alias("a"), F.col("bucket").alias("b")))
        rows = saved(seats.join(meeting, "node"), "seats")
        total, sets = rows.count(), self.sets(rows.select("node"))
        hubs = rows.groupBy("root").agg(F.max(F.struct("score", "node", "n", "part")).alias("hub"), F.count(F.lit(1)).alias("__rows"))
        hubs = saved(hubs.select("root", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.part").alias("hub_part"), "__rows"), "hubs")
        met = join_groups(rows.drop("score"), hubs, "root", total, F.col("node")).drop("root").where("node <> hub").join(sets, "node")
        hub_sets = hubs.select(F.col("hub").alias("node"), "hub").join(sets, "node").select("hub", F.col("set").alias("hub_set"))
        met = join_dealt(met, hub_sets, "hub", hubs.select("hub", "__rows"), total, F.col("node"))
        delta = F.concat(F.array_except("set", "hub_set"), F.array_except("hub_set", "set"))
        return saved(met.select("node", "part", *CARRIED, "hub", "hub_n", "hub_part", delta.alias("delta")), "deltas")

    def by_deltas(self, members: DataFrame, block: int = 4096) -> DataFrame:
        """Links that connect all similar ``members`` (of large buckets, with their ``part``) that share a bucket, but for those that surely fall below the similarity.

        Most sets of a large bucket are copies of one, and share nearly all that they have.
        So each set ``A`` is told by its ``delta``, what it and the hub's set ``H`` do not
        share: two sets differ as their deltas do.  Similar sets ``A`` and ``B`` differ in
        at most ``c * (|A| + |B|)`` members, with ``c = (1 - s) / (1 + s)``, so that their
        deltas share at least ``(|dA| - c * |A| + |dB| - c * |B|) / 2``.  A set that is not
        similar to ``H`` is far, with ``|d| - c * |A| > c * |H|``; and deltas of similar sets
        differ in size by no more than the sets differ.  This bounds the overlap from below
        for one delta alone, and deltas of an overlap of ``o`` share one of the first
        ``|d| - o + 1`` of each, in any one order; rare members come first here.

        Two sets that are not far are joined by their links to the hub.  Of a pair with one
        far set, that one lists what any other may share (``list``); of two far ones, both
        the first about half of that (``short``), as does a set that is not far.  Where two
        lists meet first, as much must follow in both deltas as they are to share.
        """
        deltas, similarity = self.around_hubs(members), self.similarity
        c = (1 - similarity) / (1 + similarity)
        both, either = ((F.col("n") + F.col("hub_n") + sign * F.size("delta")) / 2 for sign in (-1, 1))
        near = both >= similarity * either
        to_hub = deltas.where(near & (F.col("part") != F.col("hub_part"))).select(F.col("node").alias("a"), F.col("hub").alias("b"))
        counts = deltas.select(F.explode("delta").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        common = counts.where("n > 1").orderBy(F.desc("n"), "hash").limit(COMMON).toArrow()
        known = [x.to_numpy() for x in common.columns]
        order = np.argsort(known[0])
        shared = deltas.sparkSession.sparkContext.broadcast((known[0][order], known[1][order]))

        @F.pandas_udf("array<long>")
        def rare_first(batch: pd.Series, most: pd.Series) -> pd.Series:
            hashes, often = shared.value

            def first(delta: np.ndarray, most: int) -> np.ndarray:
                at = np.minimum(np.searchsorted(hashes, delta), max(0, len(hashes) - 1))
                n = np.where(hashes[at] == delta, often[at], 0) if len(hashes) else np.zeros(len(delta))
                return delta[np.lexsort((delta, n))[:most]]

            return pd.Series([first(*x) for x in zip(batch, most, strict=True)], index=batch.index)

        over = F.size("delta") - c * F.col("n")
        least = over - c * F.col("n") / similarity
        length = {"short": F.greatest((over + c * F.col("hub_n")) / 2, least), "long": least}
        length = {k: (F.size("delta") - F.greatest(F.ceil(x - 1e-6), F.lit(1)) + 1).cast("int") for k, x in length.items()}
        with small_batches(members.sparkSession):
            listed = deltas.withColumns({"near": near, "first": length["short"], "list": rare_first("delta", F.when(near, length["short"]).otherwise(length["long"]))})
            listed = listed.select("node", "part", *CARRIED, "hub", "near", "first", over.alias("over"), F.size("delta").alias("size"), F.posexplode("list").alias("at", "hash"))
            listed = listed.withColumns({"short": F.col("at") < F.col("first"), "onward": F.col("size") - F.col("at"), "key": F.xxhash64("hub", "hash")})
            rows = saved(listed.select("node", "part", *CARRIED, "near", "short", "over", "onward", "key"), "lists")
        keys = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count_if("short").alias("shorts"), F.count(F.lit(1)).alias("__rows"))
        keys = saved(keys.where("low <> high AND shorts > 0").select("key", "__rows", F.ceil(F.col("__rows") / block).cast("int").alias("blocks")), "keys")
        met = saved(join_groups(rows, keys, "key", rows.count(), F.col("node")).where("blocks IS NOT NULL"), "shared")
        carried = ("node", "part", "near", "short", "over", "onward", *CARRIED)
        left = met.where("short").select("key", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("block"), *[F.col(x).alias(f"a_{x}") for x in carried])
        right = met.where("NOT near").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(x).alias(f"b_{x}") for x in carried])
        wanted = F.col("a_near") | (F.col("b_short") & (F.col("a_node") < F.col("b_node")))
        enough = F.least("a_onward", "b_onward") + 1e-6 >= (F.col("a_over") + F.col("b_over")) / 2
        found = left.join(right, ["key", "block"]).where((F.col("a_part") != F.col("b_part")) & wanted & enough & _may_reach(similarity))
        return found.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).unionByName(to_hub)


def keep_one_per_group(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = 1, segments: int = 3, max_bucket: int = 64, turns: int = 3
) -> DataFrame:
    """``df`` with one row of each group of near copies: the one with the least id.

    Near copies have a Jaccard similarity of ``similarity`` or more in ``shingle``-word
    shingles.  A fingerprint over all shingles lies too far off for a filter there (about
    10 of 64 bits at 0.8).  So each text has ``FAMILIES`` fingerprints, each over the
    ``SAMPLE`` shingles that come first in an order of its own; near copies have equal
    samples, whatever the kind of edit, but for a probability of 0.003 at 0.8.  Texts
    with fingerprints of one family within ``distance`` bits, by pigeonring, are
    candidates, and all candidates are compared by their whole shingle sets.  With 3
    pieces and 1 bit the equal chain has about 42 bits, so that chance meetings do not
    grow with the table.

    First each text of a bucket of candidates is compared with the bucket's hub, and with
    others in ``turns``, which joins most groups.  Then those that are still apart are
    compared with each other: all of them in a bucket of at most ``max_bucket``; in a larger
    one, those that share one of the rarest shingles in which they differ from its hub,
    which loses no pair of the similarity (``by_deltas``).

    Rows with a null id stay; rows that repeat an id are told apart by their text, and
    rows that repeat both are one.  Texts of equal shingle sets (by a 64-bit digest) are
    one node; equal fingerprints are compared like others.
    """
    ids = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__mark")).where("__id IS NOT NULL")
    copies = NearCopies(ids, shingle, similarity)
    members = copies.buckets(distance, segments, max_bucket)
    # groups so far, as links from nodes to their roots, stand for all links found
    joined, still, total = None, members.withColumn("part", F.col("node")), members.count()
    for turn in range(turns):
        new = copies.verified(copies.to_hubs(still, turn, total))
        roots = connected_components(new if joined is None else joined.unionByName(new))
        joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        still = copies.apart(members, roots, total)
        if turn and new.isEmpty() or still.where(F.col("size") > max_bucket).isEmpty():
            break
    few, many = still.where(F.col("size") <= max_bucket), still.where(F.col("size") > max_bucket)
    more = copies.across(few, "bucket")
    if not many.isEmpty():
        more = more.unionByName(copies.by_deltas(many))
    roots = connected_components(joined.unionByName(copies.verified(more)))
    keepers = copies.nodes.join(roots, "node", "left").select("node", "__rows", "least", F.coalesce("root", "node").alias("root"))
    best = keepers.groupBy("root").agg(F.min("least").alias("keep"))
    total = keepers.agg(F.sum("__rows")).first()[0] or 0
    rooted = join_dealt(keepers, best, "root", keepers.groupBy("root").agg(F.count(F.lit(1)).alias("__rows")), total, F.col("node"))
    found = join_groups(copies.rows.select("__id", "__mark", "node"), rooted.select("node", "__rows", "keep"), "node", total, F.col("__id"))
    dropped = saved(found.where("__id <> keep.__id OR __mark <> keep.__mark").select("__id", "__mark").distinct(), "dropped")
    here = (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__mark"))
    kept = df.join(dropped, here, "left_anti")
    repeated = saved(copies.rows.groupBy("__id", "__mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id", "__mark"), "repeated")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, here, "left_semi").withColumn("__mark", F.xxhash64(text_col)).dropDuplicates([id_col, "__mark"]).drop("__mark")
    return kept.join(repeated, here, "left_anti").unionByName(again)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grouped = group_documents(hash_documents(docs))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
