"""Corpus pipeline: each stage's result is written as Parquet and reread as the next one's input.

Language ID drops documents in no language; exact dedup keeps the first of equal
texts; near-dedup keeps one document of each group of near copies (a similarity of
0.8 or more in five-word shingles); mixing repeats or leaves out documents so that
sources come near their target weights; BPE encodes what the mix holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaverlake.llm import bpe, exact_dedup, language_id, simhash_dedup, source_mixing
from quaverlake.llm.common import new_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(language_id.learnable(docs)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one_per_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.emit_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources", mix),
    ("BPE encoding", encode),
]

#: Trained language models and fingerprint groups are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
