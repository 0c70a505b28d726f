"""What the operators hold in a Python worker, beside its rows."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quaverlake.llm import bpe, language_id, simhash_dedup


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_scoring_a_long_text():
    """The arrays of scoring are those of a piece, not of the text or the batch."""
    texts = {"a": "abcd efgh " * 300, "b": "stuv wxyz " * 300}
    codes = {lang: np.unique(language_id.string_codes(language_id.PAD * 4 + t.encode(), 4)[4:], return_counts=True) for lang, t in texts.items()}
    counts = pd.concat([pd.DataFrame({"lang": lang, "code": c.view(np.int64), "n": n}) for lang, (c, n) in codes.items()])
    model = language_id.build(counts, 4)
    long = ["wxyz stuv " * 200_000, "efgh abcd " * 100_000]
    found = []
    assert peak_mb(lambda: found.append(language_id.predict(model, long))) < 25
    assert found[0][0] == ["b", "a"]


class Plain:
    def word(self, word):
        return [1]

    def decode(self, ids):
        return "x"


def test_remembered_words():
    words = bpe.Words(Plain())

    def work():
        for k in range(700_000):
            words[f"word {k}"]

    assert peak_mb(work) < 110
    assert words["word 1"] == ("1", "x")


def test_shingle_sets_in_small_batches(spark, monkeypatch):
    """Each Python worker gets few texts at a time, and the setting is as it was afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def lengths(text, shingle):
        @F.pandas_udf("array<long>")
        def counted(batch: pd.Series) -> pd.Series:
            return pd.Series([[len(batch)]] * len(batch))

        return counted(text)

    monkeypatch.setattr(simhash_dedup, "shingle_hashes", lengths)
    ids = spark.range(0, 3000, 1, 1).select(F.col("id").alias("__id"), F.concat(F.lit("one two three four five "), F.col("id").cast("string")).alias("__text"), F.lit(0).alias("__mark"))
    copies = simhash_dedup.NearCopies(ids, 5, 0.8)
    most = copies.sets(copies.nodes.select("node")).agg(F.max(F.col("set")[0]), F.count(F.lit(1))).first()
    assert tuple(most)[0] <= 1000
    assert tuple(most)[1] == 3000
    assert spark.conf.get(key) == before
