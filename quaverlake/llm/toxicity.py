"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled ones are drawn from all
text that may be learned from, whatever its label and positives included, so that the
prior is theirs too.  With a class prior ``p`` and logistic loss ``l`` a linear classifier
minimises the corrected risk ``p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)])``, by
mini-batches; where the second term falls below zero, the step goes against it, so
that flexible classifiers cannot make it negative by overfitting.

A text's features are its distinct lower-cased words and their beginnings, hashed to ``2 ** bits``
places.
Several classifiers are trained, each in a task of its own, on a hashed sample with a
bound documented at ``fit``, and their margins averaged.  The prior is the share of
toxic rows among the labelled rows learned from.

Defined cases: null and empty texts have no features and score by the bias; rows
with a null id are scored and not learned from; with no positives to learn from, all
scores are the prior; repeated rows score alike; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, crc_remainder, saved, table

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that count as features, for inflected and compound words.
STEMS = (4, 5, 6, 7, 8)
#: Bytes of one generation of remembered words, in each Python worker.
CACHE_BYTES = 48 << 20


class Places(Remembered):
    """Word to the hashed places of itself and its stems, remembered up to a bound."""

    def __init__(self, bits: int):
        super().__init__(CACHE_BYTES)
        self.mask = (1 << bits) - 1

    def fresh(self, word: str) -> tuple[int, ...]:
        parts = {word + "$", *(word[:n] for n in STEMS if n <= len(word))}
        return tuple(zlib.crc32(p.encode("utf-8", "replace")) & self.mask for p in parts)

    def of(self, text: str | None) -> np.ndarray:
        words = set(WORD.findall((text or "").lower()))
        return np.array(sorted(set(chain.from_iterable(map(self.__getitem__, words)))), dtype=np.int64)


@functools.cache
def places_of(bits: int) -> Places:
    """One a Python worker."""
    return Places(bits)


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    bits: int

    def scores(self, texts: list[str | None]) -> np.ndarray:
        places = places_of(self.bits)
        margins = np.array([self.weights[places.of(t)].sum() for t in texts]) + self.bias
        return 1 / (1 + np.exp(-np.clip(margins, -50, 50)))


def _matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all rows in one array, and where each row starts (rows are never empty: place 0 is the bias)."""
    lengths = np.array([len(r) for r in rows])
    return np.concatenate(rows), np.cumsum(lengths) - lengths


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int, seed: int, epochs: int = 12, rate: float = 0.2, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier; feature rows hold distinct places below ``size``."""
    rng = np.random.default_rng(seed)
    w, grad2 = np.zeros(size + 1), np.full(size + 1, 1e-8)
    add_bias = lambda rows: [np.append(r, size) for r in rows]
    positive, unlabelled = add_bias(positive), add_bias(unlabelled)
    batches = max(1, len(unlabelled) // 256)
    w[size] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    for _ in range(epochs):
        up, uu = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for b in range(batches):
            p = [positive[k] for k in up[b::batches]] or [positive[up[b % len(up)]]]
            u = [unlabelled[k] for k in uu[b::batches]]
            (fp, sp), (fu, su) = _matrix(p), _matrix(u)
            gp, gu = np.add.reduceat(w[fp], sp), np.add.reduceat(w[fu], su)
            sig_p, sig_u = 1 / (1 + np.exp(-np.clip(gp, -50, 50))), 1 / (1 + np.exp(-np.clip(gu, -50, 50)))
            # losses of calling unlabelled and positive rows negative: softplus(g)
            rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            down_p, down_u = -prior * sig_p / len(p), sig_u / len(u)
            if rest >= 0:
                at_p, at_u = -prior * (1 - sig_p) / len(p) + down_p, down_u
            else:  # climb back out of a negative risk
                at_p, at_u = -down_p, -down_u
            grad = np.bincount(fp, np.repeat(at_p, np.diff(np.append(sp, len(fp)))), size + 1)
            grad += np.bincount(fu, np.repeat(at_u, np.diff(np.append(su, len(fu)))), size + 1)
            grad += decay * w
            grad2 += grad * grad
            w -= rate * grad / np.sqrt(grad2)
    return w[:size], float(w[size])


def _train_member(rows: pd.DataFrame, prior: float, bits: int, least_share: float, least_lift: float) -> pd.DataFrame:
    rows = rows.sort_values("hash")
    split = {k: [np.asarray(x, dtype=np.int64) for x in rows.loc[rows["positive"] == k, "places"]] for k in (True, False)}
    if not split[True] or not split[False]:
        return pd.DataFrame({"place": [], "weight": []})
    # rare words, or such as positives and others share, would let the classifier learn its positives by heart
    share = {k: np.bincount(np.concatenate(part), minlength=1 << bits) / len(part) for k, part in split.items()}
    common = (share[True] >= least_share) & (share[True] >= least_lift * share[False])
    split = {k: [x[common[x]] for x in part] for k, part in split.items()}
    w, bias = train_nnpu(split[True], split[False], prior, 1 << bits, int(rows["member"].iloc[0]))
    used = np.flatnonzero(w)
    return pd.DataFrame({"place": np.append(used, -1), "weight": np.append(w[used], bias)})


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 18, members: int = 3, positives: int = 1500, unlabelled: int = 6000, least_share: float = 0.02, least_lift: float = 2.0) -> Classifier:
    """The averaged classifier of ``members`` trained ones.

    Each learns from at most ``positives`` toxic rows and ``unlabelled`` rows of any kind of
    ``df``, about: a row belongs to a member's sample if its hash falls below the share
    that the bound is of all rows; a toxic row may be in both.  Features are those in at
    least ``least_share`` of the positives, and ``least_lift`` times as often as in the
    unlabelled: with some hundred positives, words of only a few of them, or of all text,
    separate the sample by chance, and the corrected risk cannot tell.  ``labels`` are
    those that may be learned from.
    """
    marks = labels.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label"))
    rows = df.where(F.col(id_col).isNotNull())
    ids = saved(rows.select(F.col(id_col).alias("__row")).join(marks, F.col("__row") == F.col("__id"), "left").select("__row", "__label"), "labelled")
    n = ids.agg(F.count_if(F.col("__label") == 1).alias("p"), F.count_if(F.col("__label") == 0).alias("n"), F.count(F.lit(1)).alias("all")).first()
    prior = n["p"] / max(1, n["p"] + n["n"])
    if not n["p"] or n["p"] == n["all"]:
        return Classifier(np.zeros(1 << bits), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))), bits)
    sides = [ids.where("__label = 1").select("__row", F.lit(True).alias("positive"), F.lit(min(1.0, positives / n["p"])).alias("share"))]
    sides.append(ids.select("__row", F.lit(False).alias("positive"), F.lit(min(1.0, unlabelled / n["all"])).alias("share")))
    drawn = sides[0].unionByName(sides[1]).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    drawn = drawn.withColumn("hash", F.pmod(F.xxhash64("__row", "member", "positive"), F.lit(1 << 30)) / F.lit(float(1 << 30))).where("hash < share").drop("share")
    # a small table, which the join can broadcast, so that no text is shuffled
    drawn = saved(drawn.distinct(), "drawn")

    @F.pandas_udf("array<int>")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = places_of(bits)
        for batch in batches:
            yield batch.map(lambda t: known.of(t).astype(np.int32))

    texts = rows.select(F.col(id_col).alias("__row"), F.col(text_col).alias("__text"))
    sample = texts.join(drawn, "__row").select("member", "positive", "hash", places("__text").alias("places"))
    learned = sample.groupBy("member").applyInPandas(lambda x: _train_member(x, prior, bits, least_share, least_lift), "place int, weight double").toPandas()
    weights = np.zeros(1 << bits)
    inner = learned[learned["place"] >= 0]
    trained = max(1, int((learned["place"] < 0).sum()))
    np.add.at(weights, inner["place"].to_numpy(dtype=np.int64), inner["weight"].to_numpy() / trained)
    return Classifier(weights, float(learned.loc[learned["place"] < 0, "weight"].sum() / trained), bits)


def toxicity(text: Column, classifier: Classifier) -> Column:
    """Scores from 0 to 1.  The classifier has ``2 ** bits`` weights, whatever the input."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(classifier)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            yield pd.Series(model.scores(batch.tolist()), dtype="float64")

    return scored(text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(crc_remainder(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")
    # held-out texts take no part in training, labelled or not
    classifier = fit(docs.where(~held_out), labels)
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity(F.col("text"), classifier).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
