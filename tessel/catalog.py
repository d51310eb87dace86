"""All registered queries of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.queries import ORACLE_SQL, QUERIES, files, records, retrieval, tables, texts  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top-k retrieval."""
    return QUERIES["w1_top_k"](spark, sf_dir)
