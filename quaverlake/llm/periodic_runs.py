r"""Periodic runs of words: harmonic grid probing.

A stretch of period p in which p or more words equal the word p places on meets the
grid of p: some jp in it has word jp equal to word (j+1)p.  So for each period only
the n / p grid points are probed, n ln n probes in all.  A point whose words are
equal is tested against its neighbours, and what survives is extended to both sides
by comparing arrays in growing chunks.  Periods are probed in ascending order, and
where a found run holds a grid point of a multiple of its period, the point is
skipped: its stretch would be that run again.

A run is a stretch of consecutive words of smallest period q, of ``least`` words or
more and of two periods or more, that no neighbouring word extends.  Collapsing
keeps of each run the first q words, and drops what any run has beyond those.

The grids of all periods of a text of up to ``SHORT`` words are probed at once, by a
table of the points that each worker keeps.  For longer texts periods are taken in
ranges from a power of two to the next, so that besides its words a text needs memory
for the probes of one range, no more than its number of words.

Defined cases: null text has no words, and so no runs; words are split at ASCII
white space and compared byte by byte; texts are taken whole, however long; repeated
rows are each taken for themselves; an empty table gives an empty result; input
columns named like a result column are replaced by it.  A row without id is not
planted in ``query``.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

LEAST = 12
#: Places to each side of a grid point that are compared before a chunked extension.
NEAR = 6
#: Grid points tested against their neighbours at a time.
PIECE = 1 << 16
#: So few points are extended without further tests.
FEW = 32
SHORT = 4096


@functools.cache
def points(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid points of all periods in a text of ``most`` words, by their second place: both places, and for each n the number of points in a text of n words."""
    second = np.concatenate([np.arange(p, most, p) for p in range(1, most)])
    first = second - np.concatenate([np.full(len(range(p, most, p)), p) for p in range(1, most)])
    order = np.argsort(second, kind="stable")
    first, second = first[order], second[order]
    return first, second, np.searchsorted(second, np.arange(most + 1))


def short_grid(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``grid``, of all periods up to half of a text of ``SHORT`` words or fewer."""
    first, second, count = points(SHORT)
    n = len(words)
    hit = np.flatnonzero(words.take(first[: count[n]]) == words.take(second[: count[n]]))
    places, periods = first[hit], second[hit] - first[hit]
    keep = 2 * periods <= n
    return places[keep], periods[keep]


def grid(words: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the grid points of the periods from ``low`` to ``high`` - 1 whose words are equal."""
    n, places, periods = len(words), [], []
    if high - low <= n // low:
        for p in range(low, high):
            hit = np.flatnonzero(words[: n - p : p] == words[p::p]) * p
            places.append(hit)
            periods.append(np.full(len(hit), p))
    else:
        for j in range(-(-n // low)):
            top = min(high, (n - 1) // (j + 1) + 1)  # the periods whose point j+1 lies in the text
            if top <= low:
                break
            here = words[j * low : j * (top - 1) + 1 : j] if j else words[:1]
            hit = low + np.flatnonzero(here == words[(j + 1) * low : (j + 1) * (top - 1) + 1 : j + 1])
            places.append(hit * j)
            periods.append(hit)
    return np.concatenate(places), np.concatenate(periods)


def unskipped(places: np.ndarray, periods: np.ndarray, low: int, high: int, runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """False for points of a multiple of a found run's period that lie in the run."""
    found = [(p * (n + 1) + start, p * (n + 1) + start + length - p) for start, length, q in runs for p in range(max(2 * q, -(-low // q) * q), min(high, length - q + 1), q)]
    if not found:
        return np.full(len(places), True)
    spans = np.array(sorted(found))
    at = periods * (n + 1) + places
    k = np.searchsorted(spans[:, 0], at, "right") - 1
    return (k < 0) | (at >= spans[k, 1])


def hopeful(words: np.ndarray, places: np.ndarray, periods: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Those points whose stretch is not seen to end, on both sides within ``NEAR`` places, below the length that it needs."""
    n = len(words)
    # a stretch of one place is never enough
    before = (places > 0) & (words.take(places - 1) == words.take(places + periods - 1))
    after = (places + periods < n - 1) & (words.take(places + 1) == words.take(places + periods + 1, mode="clip"))
    keep = before | after
    places, periods = places[keep], periods[keep]
    if len(places) <= FEW:
        return places, periods
    reach, open_ended = np.ones(len(places), dtype=np.int64), np.full(len(places), False)
    for side in (1, -1):
        going = np.full(len(places), True)
        for k in range(1, NEAR + 1):
            at = places + side * k
            going &= (at >= 0) & (at + periods < n)
            going[going] = words[at[going]] == words[(at + periods)[going]]
            reach += going
        open_ended |= going
    keep = open_ended | (reach >= np.maximum(periods, least - periods))
    return places[keep], periods[keep]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal leading elements."""
    at, size, most = 0, 64, min(len(a), len(b))
    while at < most:
        end = min(most, at + size)
        differ = a[at:end] != b[at:end]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, size = end, size * 2
    return most


def periodic_runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of an array of word numbers, by start, then period."""
    n, runs, long_runs, seen, low = len(words), [], [], set(), 1
    while n >= least and 2 * low <= n:
        high = n // 2 + 1 if n <= SHORT else min(2 * low, n // 2 + 1)
        places, periods = short_grid(words) if n <= SHORT else grid(words, low, high)
        long_runs = [r for r in long_runs if r[1] - r[2] >= low]
        if long_runs:
            keep = unskipped(places, periods, low, high, long_runs, n)
            places, periods = places[keep], periods[keep]
        pieces = [hopeful(words, places[k : k + PIECE], periods[k : k + PIECE], least) for k in range(0, len(places), PIECE)]
        # by period, so that a stretch is first met with its smallest one
        points_left = sorted((p, i) for at, by in pieces for p, i in zip(by.tolist(), at.tolist(), strict=True))
        period = end = 0
        for p, i in points_left:
            if p != period:
                period, end = p, 0
            if i < end:  # within the stretch found last
                continue
            end = i + common(words[i:], words[i + p :])
            start = i - common(words[:i][::-1], words[: i + p][::-1])
            length = end + p - start
            if length >= max(least, 2 * p) and (start, length) not in seen:
                seen.add((start, length))
                runs.append((start, length, p))
                if length >= 3 * p:
                    long_runs.append((start, length, p))
        low = high
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds beyond its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def numbered(words: list) -> np.ndarray:
    """A number for each word, equal for equal words."""
    number: dict = {}
    return np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)


def planted(words: list, h: int | None) -> list:
    """The words of ``query``: where ``h`` ends in 0, those from a place on repeat with a period, both taken from ``h``."""
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


COLUMNS = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}


def described(words: list, least: int = LEAST) -> tuple:
    """The result columns for a text's words."""
    runs = periodic_runs(numbered(words), least)
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(collapsed(words, runs))
    exponent = None if period is None else 1000 * length // period
    return len(runs), start, length, period, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def describe_runs(text: Column, plant: Column | None = None, least: int = LEAST) -> Column:
    """A struct of ``COLUMNS`` for a column of texts; ``plant`` is a number that may rewrite the words first."""
    schema = f"struct<{','.join(f'{c}:{t}' for c, t in COLUMNS.items())}>"

    @F.pandas_udf(schema)
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, plants in batches:
            rows = [described(planted(t.split() if t else [], None if pd.isna(h) else int(h)), least) for t, h in zip(texts, plants, strict=True)]
            out = pd.DataFrame(rows, columns=list(COLUMNS))
            yield out.astype({c: "Int64" for c, t in COLUMNS.items() if t == "long"})

    # as bytes: these split at ASCII white space alone
    return found(text.cast("binary"), F.lit(None).cast("long") if plant is None else plant)


def find_runs(df: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``df`` with ``COLUMNS``."""
    return df.withColumn("__runs", describe_runs(F.col(text_col), least=least)).select(*[c for c in df.columns if c not in COLUMNS], "__runs.*")


def without_repeats(text: Column, least: int = LEAST) -> Column:
    """The texts with each run collapsed to its first period, words joined by one space; a text without runs stays as it is."""

    @F.pandas_udf("string")
    def short(texts: pd.Series) -> pd.Series:
        def one(t):
            words = t.split() if t else []
            runs = periodic_runs(numbered(words), least)
            return b" ".join(collapsed(words, runs)).decode() if runs else None

        return texts.map(one)

    return F.coalesce(short(text.cast("binary")), text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return docs.select("doc_id", describe_runs(F.col("text"), h).alias("found")).select("doc_id", "found.*")
