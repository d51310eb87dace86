"""A cache of computed tables, addressed by what they are computed from."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.sources.files import first_existing


def digest(ids: DataFrame, column: str) -> str:
    """A digest of a multiset of ids, whatever their order: a count and sums of hashes, so that nothing is collected."""
    row = ids.agg(F.count(column), F.sum(F.xxhash64(column).cast("decimal(38,0)")), F.sum(F.xxhash64(F.col(column), F.lit(1)).cast("decimal(38,0)"))).first()
    return hashlib.md5(repr(tuple(map(str, row))).encode()).hexdigest()[:16]


def cached(ids: DataFrame, column: str, folder: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table computed for these ids, read if it was written whole, else computed and written. A table whose number
    of rows is not that of the ids is made anew."""
    spark = ids.sparkSession
    path = f"{folder.rstrip('/')}/{digest(ids, column)}.parquet"
    if first_existing(spark, [f"{path}/_SUCCESS"]):
        got = spark.read.parquet(path)
        if got.count() == ids.count():
            return got
    compute(ids).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
