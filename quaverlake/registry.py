"""All registered queries and their SQL, but for those of optional subpackages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import audio, catalog, evaluation, exports, files, mixes, profiles, requests, scalars, similarity, states, streams  # noqa: F401  (they register their queries)
from .plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
