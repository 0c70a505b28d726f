r"""Substring dedup by recompression.

A word is removed where a window of ``window`` consecutive words covers it whose words
also stand, in this order, in a document with a smaller id.

Recompression names the tokens of each text, then runs of one token, and then, in
``rounds`` rounds, pairs: a hash of each symbol's name and the round makes it a left or
a right one, and a left symbol with a right one after it becomes one symbol.  A name is
a hash of the names that it is made of, so equal runs and pairs have equal names in all
texts without a dictionary that travels; a collision would cost work, not a result.
As only the two symbols decide about a pair, equal substrings get equal symbols inside:
each border between symbols carries the stretch of words that determines it, and a
window that holds the stretch has this border wherever it occurs.

A border of the last round is an anchor, and its key the hash of the ``probe`` words
from it.  Of the anchors that a window determines, the one of least key stands for the
window; a window without any (long runs, short periods) stands for itself.  So equal
windows have equal keys, and three rounds of grouping over Spark find the repeats:

1. Keys that occur in more than one document; other windows are unique.
2. The stretches from one anchor to the next, with all windows that start there.  A
   stretch whose windows may all repeat and that occurs in an earlier document is
   removed as a whole.
3. The windows left, at the edges of repeats and in a repeat's first document, each
   by its own hash of 128 bits.  The first document that has a window never loses it
   in the second round, so no source is missing here.

Groups are summed within tasks before they travel, and rows meet their group's figures
in a join whose large keys Spark splits.  Texts are worked on whole; a task holds about
``BATCH_WORDS`` words at a time, or one text if that is longer (some 300 bytes a word).

Defined cases: null text has no words; words are split at ASCII white space and compared
byte by byte; a null id is greater than all others; documents of equal id do not remove
each other's words, so that repeated rows share one result each; texts below ``window``
words are kept; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table

WINDOW, PROBE, ROUNDS = 50, 16, 6
BATCH_WORDS = 1 << 18
FAR = 1 << 60
#: Two odd bases of polynomial hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
ID = ["__doc", "__text"]
HASHES = "array<struct<a:long,b:long>>"


@dataclass(frozen=True)
class Parse:
    """The parameters: windows of so many words, keys of ``probe`` words, rounds of pairs."""

    window: int = WINDOW
    probe: int = PROBE
    rounds: int = ROUNDS


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base % (1 << 64), dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Hashes:
    """Hashes of stretches of an array of word hashes, from sums of prefixes."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * powers(base, n)[:n], dtype=np.uint64)])
        self.back = powers(pow(base, -1, 1 << 64), n)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


@dataclass
class Symbols:
    """Symbols of the texts: names, first places, first of a text; and of the border at each start the places between which the words determine it."""

    name: np.ndarray
    start: np.ndarray
    first: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def kept(self, keep: np.ndarray, name: np.ndarray, left: np.ndarray, right: np.ndarray) -> Symbols:
        return Symbols(name[keep], self.start[keep], self.first[keep], left[keep], right[keep])


def named_runs(words: np.ndarray, first: np.ndarray) -> Symbols:
    """Runs of one word as one symbol each; a border lies between two different words, which determine it."""
    n = len(words)
    keep = first.copy()
    keep[1:] |= words[1:] != words[:-1]
    start = np.flatnonzero(keep)
    length = np.diff(start, append=n).astype(np.uint64)
    name = np.where(length > 1, mixed(words[start] + length * np.uint64(BASES[1])), words[start])
    opens = first[start]
    return Symbols(name, start, opens, np.where(opens, -FAR, start - 1), start + 1)


def named_pairs(s: Symbols, number: int) -> Symbols:
    """A round: a left symbol and the right one after it become one.

    A border stays for certain if the symbol after it is a left one, or else if that and
    the one before it are right ones; so the words that determine it are those of the
    symbol after it, and in the second case of the one before it too.
    """
    if not len(s.name):
        return s
    is_right = mixed(s.name + np.uint64((2 * number + 1) * BASES[0] % (1 << 64))) >> np.uint64(63) == 1
    joins = np.zeros(len(s.name), dtype=bool)
    joins[1:] = is_right[1:] & ~is_right[:-1] & ~s.first[1:]
    following = np.full(len(s.name), FAR)
    following[:-1] = np.where(s.first[1:], FAR, s.right[1:])
    previous = np.concatenate([[-FAR], s.left[:-1]])
    left = np.where(s.first, -FAR, np.where(is_right, np.minimum(s.left, previous), s.left))
    name = s.name.copy()
    at = np.flatnonzero(joins)
    name[at - 1] = mixed(s.name[at - 1] * np.uint64(BASES[1]) + s.name[at])
    return s.kept(~joins, name, left, np.maximum(s.right, following))


class Texts:
    """Some texts, one after the other, with the keys of their windows."""

    def __init__(self, texts: list[bytes | None], how: Parse):
        self.how, self.words = how, [t.split() if t else [] for t in texts]
        self.begin = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for words in self.words for w in words], dtype=np.int64)
        one, two = (np.array([xxhash.xxh64_intdigest(w, seed) for w in number], dtype=np.uint64)[ids] for seed in (1, 2))
        self.hashes = [Hashes(w, base) for w, base in zip((one, two), BASES, strict=True)]
        n = int(self.begin[-1])
        first = np.zeros(n, dtype=bool)
        first[self.begin[:-1][np.diff(self.begin) > 0]] = True
        symbols = named_runs(one, first)
        for k in range(how.rounds):
            symbols = named_pairs(symbols, k)
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.begin))
        last_start = np.repeat(self.begin[1:] - how.window, np.diff(self.begin))
        self.is_window = np.arange(n) <= last_start
        self._choose(symbols, last_start, n)

    def _choose(self, s: Symbols, last_start: np.ndarray, n: int) -> None:
        """``anchor``: of each window the place of its anchor, or -1; ``places``: where keys stand, an anchor's or a window's own."""
        window, probe = self.how.window, self.how.probe
        low = np.maximum(np.maximum(s.right, s.start + probe) - window, self.begin[self.text_of[s.start]])
        high = np.minimum(s.left, last_start[s.start])
        usable = low <= high
        place, low, high = s.start[usable], low[usable], high[usable]
        key = self.hashes[0](place, place + probe)
        # the least key is written last; of equal ones the first place
        order = np.argsort(key, kind="stable")[::-1]
        place, low, length = place[order], low[order], (high - low + 1)[order]
        ahead = np.cumsum(length) - length
        windows = np.repeat(low - ahead, length) + np.arange(int(length.sum()))
        self.anchor = np.full(n, -1)
        self.anchor[windows] = np.repeat(place, length)
        own = np.flatnonzero(self.is_window & (self.anchor < 0))
        anchors = np.unique(self.anchor[self.is_window & (self.anchor >= 0)])
        self.anchors = anchors
        # an anchor's key and a window's own may stand at one place
        self.places = np.concatenate([anchors, own])
        self.is_own = np.concatenate([np.zeros(len(anchors), dtype=bool), np.ones(len(own), dtype=bool)])
        by_place = np.lexsort((self.is_own, self.places))
        self.places, self.is_own = self.places[by_place], self.is_own[by_place]

    def per_text(self, places: np.ndarray) -> np.ndarray:
        """Bounds of the sorted ``places`` of each text."""
        return np.searchsorted(places, self.begin)

    def keys(self) -> np.ndarray:
        end = self.places + np.where(self.is_own, self.how.window, self.how.probe)
        return self.hashes[0](self.places, end) ^ self.is_own.astype(np.uint64)

    def repeated(self, found: list) -> np.ndarray:
        """True for windows whose key, by its number in ``found`` of its text, occurs in several documents."""
        bounds = self.per_text(self.places)
        hit = np.zeros(len(self.places), dtype=bool)
        for k, numbers in enumerate(found):
            hit[bounds[k] + np.asarray(numbers, dtype=np.int64)] = True
        shared = np.zeros(len(self.anchor) + 1, dtype=bool)
        shared[self.places[hit & ~self.is_own]] = True
        # windows without an anchor ask the last element, which is false
        out = shared[self.anchor] & self.is_window
        out[self.places[hit & self.is_own]] = True
        return out

    def stretches(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window and one past the last window of the stretches whose windows are all repeated."""
        start = np.union1d(self.begin[:-1][np.diff(self.begin) > 0], self.anchors)
        if not len(start):
            return start, start
        stop = np.concatenate([start[1:], [len(self.anchor)]])
        last = self.begin[self.text_of[start] + 1] - self.how.window + 1
        stop = np.minimum(stop, last)
        counts = np.concatenate([[0], np.cumsum(repeated)])
        full = stop > start
        full[full] = counts[stop[full]] - counts[start[full]] == (stop - start)[full]
        return start[full], stop[full]

    def pairs(self, start: np.ndarray, end: np.ndarray) -> list[list[dict]]:
        """Hashes of 128 bits of stretches of words, for each text."""
        a, b = (h(start, end).view(np.int64).tolist() for h in self.hashes)
        both = [{"a": x, "b": y} for x, y in zip(a, b, strict=True)]
        bounds = self.per_text(start)
        return [both[bounds[k] : bounds[k + 1]] for k in range(len(self.words))]

    def split(self, values: np.ndarray, places: np.ndarray) -> list[list]:
        bounds, values = self.per_text(places), values.tolist()
        return [values[bounds[k] : bounds[k + 1]] for k in range(len(self.words))]


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of few enough words, by the texts' bytes."""
    for frame in frames:
        size = frame["text"].map(lambda t: len(t) // 5 if t else 0).cumsum() // BATCH_WORDS
        for _, part in frame.groupby(size.to_numpy(), sort=False):
            yield part.reset_index(drop=True)


def over_texts(df: DataFrame, schema: str, one: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames):
            yield one(part)[names]

    return df.mapInPandas(run, schema)


def met_elsewhere(rows: DataFrame, hashes: str, earlier: bool) -> DataFrame:
    """By document, the numbers in its ``hashes`` of those that occur in another document; with ``earlier``, in one of smaller id."""
    each = rows.select(*ID, F.posexplode(hashes).alias("number", "hash")).select(*ID, "number", "hash.a", "hash.b")
    groups = each.groupBy("a", "b").agg(F.min("__doc").alias("least"), F.max("__doc").alias("most")).where("least < most").drop("most")
    met = each.join(groups, ["a", "b"])
    met = met.where("least < __doc") if earlier else met
    # a set, as repeated rows of one document have the same numbers
    return met.groupBy(*ID).agg(F.collect_set("number").alias("found"))


def listed(column: pd.Series) -> list:
    return [() if x is None else x for x in column]


def removed_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Parse = Parse()) -> DataFrame:
    """Of each row its id, ``n_words``, ``n_removed`` and ``kept``, the words left joined by one space, as ``kept_text`` and its ``kept_sha256``."""
    return _results(df, id_col, text_col, how, True)


def _results(df: DataFrame, id_col: str, text_col: str, how: Parse, with_text: bool) -> DataFrame:
    id_type = df.schema[id_col].dataType.simpleString()
    texts = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(np.iinfo(np.int64).max)).alias("__doc"), F.xxhash64(F.col(text_col)).alias("__text"),
        F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("text"),
    )
    output = f"__id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def first(part: pd.DataFrame) -> pd.DataFrame:
        t = Texts(part["text"].tolist(), how)
        keys = t.keys().view(np.int64).tolist()
        bounds = t.per_text(t.places)
        lists = [[{"a": x, "b": 0} for x in keys[bounds[k] : bounds[k + 1]]] for k in range(len(t.words))]
        out = part.assign(keys=lists, n_words=[len(w) for w in t.words], n_removed=0, kept_sha256=[digest(w) for w in t.words])
        return out.assign(kept_text=[b" ".join(w).decode() for w in t.words]) if with_text else out

    every = f"__doc long, __text long, {output}, keys {HASHES}"
    keyed = saved(over_texts(texts, every, first), "keys")
    shared = saved(met_elsewhere(keyed, "keys", False), "shared-keys")
    affected = saved(texts.join(shared, ID), "affected-texts")

    def second(part: pd.DataFrame) -> pd.DataFrame:
        t = Texts(part["text"].tolist(), how)
        start, stop = t.stretches(t.repeated(listed(part["found"])))
        return part.assign(stretches=t.pairs(start, stop + how.window - 1))

    stretched = saved(over_texts(affected, f"__doc long, __text long, stretches {HASHES}", second), "stretches")
    covered = met_elsewhere(stretched, "stretches", True).withColumnRenamed("found", "covered")

    def third(part: pd.DataFrame) -> pd.DataFrame:
        t = Texts(part["text"].tolist(), how)
        repeated = t.repeated(listed(part["found"]))
        start, stop = t.stretches(repeated)
        bounds, hit = t.per_text(start), np.zeros(len(start), dtype=bool)
        for k, numbers in enumerate(listed(part["covered"])):
            hit[bounds[k] + np.asarray(numbers, dtype=np.int64)] = True
        for a, b in zip(start[hit].tolist(), stop[hit].tolist(), strict=True):
            repeated[a:b] = False
        left, begin = np.flatnonzero(repeated), t.begin[t.text_of]
        return part.assign(
            windows=t.pairs(left, left + how.window), places=t.split(left - begin[left], left),
            starts=t.split((start - begin[start])[hit], start[hit]), stops=t.split((stop - begin[start])[hit], start[hit]),
        )

    edges = over_texts(affected.join(covered, ID, "left"), f"__doc long, __text long, windows {HASHES}, places array<long>, starts array<long>, stops array<long>", third)
    edges = saved(edges, "windows")
    single = met_elsewhere(edges, "windows", True).withColumnRenamed("found", "single")
    cuts = edges.drop("windows").dropDuplicates(ID).join(single, ID, "left")

    def last(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text, places, starts, stops, numbers in zip(part["text"], *(listed(part[c]) for c in ("places", "starts", "stops", "single")), strict=True):
            words = text.split() if text else []
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            at = np.asarray(places, dtype=np.int64)[np.asarray(numbers, dtype=np.int64)]
            np.add.at(edge, np.concatenate([np.asarray(starts, dtype=np.int64), at]), 1)
            np.add.at(edge, np.concatenate([np.asarray(stops, dtype=np.int64) - 1, at]) + how.window, -1)
            kept = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            rows.append((len(words), len(words) - len(kept), digest(kept), b" ".join(kept).decode() if with_text else None))
        return part.assign(**dict(zip(("n_words", "n_removed", "kept_sha256", "kept_text"), map(list, zip(*rows, strict=True)), strict=True)))

    changed = over_texts(affected.join(cuts, ID), output, last)
    same = keyed.join(shared.select(*ID), ID, "left_anti").select(changed.columns)
    return same.unionByName(changed).withColumnRenamed("__id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return _results(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", Parse(), False)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, words[i] AS word, CASE WHEN i + 49 <= len(words) THEN md5(array_to_string(words[i:i + 49], ' ')) END AS key FROM w),
m AS (SELECT *, key IS NOT NULL AND min(doc_id) OVER (PARTITION BY key) < doc_id AS again FROM k),
r AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS removed FROM m),
g AS (SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT removed) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(g.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
