"""The queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_join, exact_dedup, language_id, periodic_runs, prefix_trie, secret_scan, simhash_dedup, source_mixing, substring_dedup, token_files, toxicity, warc

MODULES = {
    "op1_language_id": language_id,
    "op2_token_files": token_files,
    "op3_bpe_codec": bpe,
    "op4_embedding_join": embedding_join,
    "op5_secret_scan": secret_scan,
    "op6_exact_dedup": exact_dedup,
    "op7_toxicity": toxicity,
    "op8_source_mixing": source_mixing,
    "op9_warc_revisits": warc,
    "op10_simhash_dedup": simhash_dedup,
    "op11_substring_dedup": substring_dedup,
    "op12_prefix_trie": prefix_trie,
    "op13_periodic_runs": periodic_runs,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in MODULES.items() if getattr(module, "ORACLE", None)}
