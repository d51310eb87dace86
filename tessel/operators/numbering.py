"""Numbers for the rows of a table in a global order, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.plans.lineage import cut, free_name


def numbered(rows: DataFrame, *order: str | Column, out: str = "pos") -> DataFrame:
    """``rows`` with their place from 0 in the order given, in a column that replaces one of the name ``out``.

    The rows are dealt to ranges and written; a range's rows are counted, the counts of all ranges summed up, one number
    for each, and added to the place within the range. Ties have some order, the same for one result.
    """
    place, part, begin = (free_name(x, rows) for x in ("place", "part", "begin"))
    ranged = cut(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = ranged.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = cut(counts.select(part, before.alias(begin)))  # a row for each range
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    placed = ranged.withColumn(place, within).join(begins, part)
    kept = [c for c in rows.columns if c.lower() != out.lower()]
    return placed.select(*kept, (F.col(begin) + F.col(place)).cast("long").alias(out))
