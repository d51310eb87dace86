"""Registered queries, by area: each has a DataFrame form and, where SQL can express it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, tables) -> DataFrame, where tables(name) reads a table of the folder given."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return register
