"""Language ID by prediction by partial matching over bytes.

Each language has a context tree of up to ``order`` bytes: counts of the byte that
follows each context.  A byte seen after the longest context costs
``-log2(n / (N + d))`` bits (``n`` of ``N`` occurrences, ``d`` different bytes), and
otherwise the escape ``-log2(d / (N + d))`` plus its cost after the next shorter
context, down to uniform bytes.  Statistics are frozen after training, so the cost
of a byte depends on it and the ``order`` bytes before only; the trees are laid out
as hash tables from such strings to the cost in every language, and scoring a text
is one lookup a byte, with shorter contexts for strings no language has seen.

Trees are fitted on at most ``docs_per_language`` labelled documents a language,
those with the least hashes, and ``bytes_per_language`` bytes of them; scoring covers
every byte of every text.  The
prediction has the shortest code; the score is its posterior under equal priors.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so
is every text where nothing was learned; ties go to the first language by name;
rows with a null id or label are scored and not learned from; repeated rows are
scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, saved, table

UNDETERMINED = "und"
PAD = b"\n"
#: Bytes that are scored at once, each with some 80 bytes of arrays; and texts that are encoded at once.
PIECE, TEXTS = 1 << 16, 256
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Lookup:
    """A hash table from byte strings, as integers, to row numbers."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, EMPTY, dtype=np.uint64)
        self.rows = np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == EMPTY
            at, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            self.keys[at], self.rows[at] = keys[put], put
            stay = ~np.isin(left, put)
            left, slot = left[stay], slot[stay]
            taken = self.keys[slot] != EMPTY
            slot = np.where(taken, (slot + 1) & self.mask, slot)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where unknown."""
        slot = self._slot(codes)
        found = np.where(self.keys[slot] == codes, self.rows[slot], -1)
        left = np.flatnonzero((found < 0) & (self.keys[slot] != EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            hit = self.keys[slot] == codes[left]
            found[left[hit]] = self.rows[slot[hit]]
            on = ~hit & (self.keys[slot] != EMPTY)
            left, slot = left[on], slot[on]
        return found


@dataclass
class Model:
    """Frozen trees: per length of context, strings with their costs, and contexts with their escapes."""

    languages: list[str]
    order: int
    single: np.ndarray
    strings: list[tuple[Lookup, np.ndarray]]
    escapes: list[tuple[Lookup, np.ndarray]]

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Bits in each language of the last byte of each string of ``order + 1`` bytes."""
        cost = np.zeros((len(codes), len(self.languages)), dtype=np.float32)
        left = np.arange(len(codes))
        for k in range(self.order, 0, -1):
            own = codes[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            strings, bits = self.strings[k - 1]
            row = strings.find(own)
            hit = row >= 0
            cost[left[hit]] += bits[row[hit]]
            left, own = left[~hit], own[~hit]
            contexts, escape = self.escapes[k - 1]
            row = contexts.find(own >> np.uint64(8))
            known = row >= 0
            cost[left[known]] += escape[row[known]]
        cost[left] += self.single[(codes[left] & np.uint64(255)).astype(np.int64)]
        return cost

    def text_bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths (texts x languages), in pieces of bounded size."""
        total, batch, size = np.zeros((len(texts), len(self.languages))), [], 0
        for i, text in enumerate(texts):
            padded = PAD * self.order + text
            for at in range(0, len(text), PIECE):
                piece = padded[at : at + PIECE + self.order]
                batch.append((i, piece))
                size += len(piece)
                if size >= PIECE:
                    self._add(batch, total)
                    batch, size = [], 0
        if batch:
            self._add(batch, total)
        return total

    def _add(self, batch: list[tuple[int, bytes]], total: np.ndarray) -> None:
        codes = string_codes(b"".join(p for _, p in batch), self.order)
        lengths = np.array([len(p) for _, p in batch])
        starts = np.cumsum(lengths) - lengths
        cost = self.costs(codes)
        cost[(starts[:, None] + np.arange(self.order)).ravel()] = 0
        np.add.at(total, [i for i, _ in batch], np.add.reduceat(cost, starts, axis=0, dtype=np.float64))


def string_codes(data: bytes, order: int) -> np.ndarray:
    """At each byte, it and the ``order`` bytes before as an integer, the byte itself lowest."""
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    codes = raw.copy()
    for k in range(1, order + 1):
        codes[k:] |= raw[:-k] << np.uint64(8 * k)
    return codes


def string_counts(df: DataFrame, order: int, lang_col: str, text_col: str) -> DataFrame:
    """Counts of the byte strings of ``order + 1`` bytes by language."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for text in texts:
                    codes = string_codes(PAD * order + text.encode("utf-8", "replace"), order)[order:]
                    found, n = np.unique(codes, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "code": found.view(np.int64), "n": n})

    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInPandas(counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def build(counts: pd.DataFrame, order: int) -> Model:
    """The frozen model of counts (lang, code, n)."""
    lang = counts["lang"].astype("category").cat.remove_unused_categories()
    lang = lang.cat.reorder_categories(sorted(lang.cat.categories))
    languages, number, codes = list(lang.cat.categories), lang.cat.codes.to_numpy(), counts["code"].to_numpy().astype(np.int64).view(np.uint64)
    n = counts["n"].to_numpy().astype(np.float64)

    def levels(length: int):
        """Distinct strings of ``length`` bytes, and their counts (strings x languages)."""
        keys, where = np.unique(codes & np.uint64((1 << 8 * length) - 1), return_inverse=True)
        out = np.zeros((len(keys), len(languages)))
        np.add.at(out, (where.ravel(), number), n)
        return keys, out

    def with_contexts(length: int):
        keys, seen = levels(length)
        contexts, where = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(total, where.ravel(), seen)
        np.add.at(kinds, where.ravel(), seen > 0)
        return keys, seen, contexts, where.ravel(), total, kinds

    keys, seen, _, _, total, kinds = with_contexts(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        single = np.tile(8 - np.log2(kinds[0] / (total[0] + kinds[0])), (256, 1))
        row = keys.astype(np.int64)
        single[row] = np.where(seen > 0, -np.log2(seen / (total[0] + kinds[0])), single[row])
        strings, escapes, below = [], [], (None, single)
        for k in range(1, order + 1):
            keys, seen, contexts, where, total, kinds = with_contexts(k + 1)
            escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0)
            shorter = keys & np.uint64((1 << 8 * k) - 1)
            row = shorter.astype(np.int64) if k == 1 else np.searchsorted(below[0], shorter)
            bits = np.where(seen > 0, -np.log2(seen / (total + kinds)[where]), escape[where] + below[1][row])
            below = (keys, bits)
            strings.append((Lookup(keys), bits.astype(np.float32)))
            escapes.append((Lookup(contexts), escape.astype(np.float32)))
    return Model(languages, order, single.astype(np.float32), strings, escapes)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, docs_per_language: int = 300, bytes_per_language: int = 1 << 23) -> Model | None:
    """Fits the trees on a sample of the rows of ``df``; None where no row has both text and label.

    Of each language it takes the documents with the least hashes, while they are at most
    ``docs_per_language`` and have ``bytes_per_language`` bytes before the last, so what
    reaches the driver has a bound of bytes a language.
    """
    from pyspark.sql import Window

    usable = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    # the row limit acts within each task first, so a common language does not gather in one
    by_hash = Window.partitionBy(lang_col).orderBy(F.md5(F.col(id_col).cast("string")), id_col)
    sized = usable.select(id_col, lang_col, F.octet_length(text_col).cast("long").alias("__bytes"))
    first = sized.withColumn("__place", F.row_number().over(by_hash)).where(F.col("__place") <= docs_per_language)
    before = F.coalesce(F.sum("__bytes").over(by_hash.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a small table, which the join can broadcast, so that no text is shuffled
    picked = saved(first.withColumn("__before", before).where(F.col("__before") < bytes_per_language).select(F.col(id_col).alias("__id")), "sample")
    sample = usable.join(picked, F.col(id_col) == F.col("__id"), "left_semi")
    # as Arrow columns: rows would take ten times the driver's memory
    counts = string_counts(sample, order, lang_col, text_col).toArrow()
    return build(counts.to_pandas(strings_to_categorical=True), order) if len(counts) else None


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if model is None:
        return names, scores
    which = [i for i, t in enumerate(texts) if t is not None and has_letter(t)]
    for at in range(0, len(which), TEXTS):
        part = which[at : at + TEXTS]
        bits = model.text_bits([texts[i].encode("utf-8", "replace") for i in part])
        for i, row in zip(part, bits, strict=True):
            best = int(row.argmin())
            names[i], scores[i] = model.languages[best], 1 / np.exp2(np.maximum(row[best] - row, -1000)).sum()
    return names, scores


def language(text: Column, model: Model | None) -> Column:
    """A struct of ``lang_pred`` and ``score``."""
    shared = None if model is None else _broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        frozen = None if shared is None else shared.value
        for batch in batches:
            names, scores = predict(frozen, batch.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return scored(text)


def _broadcast(model: Model):
    """The model's size is bounded by the sample it was fitted on."""
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(model)


def learnable(df: DataFrame) -> DataFrame:
    """The rows that a query may learn from."""
    return df.where(crc_remainder(F.col("doc_id"), 4) != 2)


def keep_identified(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` in some language: those without letters go."""
    return df.withColumn("__lang", language(F.col(text_col), model)).where(F.col("__lang.lang_pred") != UNDETERMINED).drop("__lang")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = docs.select("doc_id", language(F.col("text"), train(learnable(docs))).alias("found"))
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "found.lang_pred", "found.score")
