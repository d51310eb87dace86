"""Connected components by alternating large and small stars, as joins and minimum aggregates only.

Every round replaces each edge by edges to the smallest neighbour, first for larger neighbours and then for smaller
ones, until the edges are stars, in which all nodes point at the smallest node of their component. No task ever holds a node's neighbourhood: the
minimum is combined before the shuffle, and the join back has one row per node on its other side. That side is dealt
anew, so that the join is a stage of its own in which adaptive execution can split a hub's edges over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.plans.lineage import Kept


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v), u > v, are stars: every u has one v, and no v is a u."""
    ends = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.lit(None).cast(edges.schema["v"].dataType).alias("v")))
    per = ends.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.bool_or(F.col("v").isNull()).alias("end"))
    return per.where("lo is not null and (end or lo <> hi)").isEmpty()


def connected_components(edges: DataFrame, src: str | Column = "src", dst: str | Column = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge: component is the smallest node that it reaches.

    Edges with a null end and loops are dropped; repeated edges count once; an empty table gives an empty one.
    """
    src, dst = (F.col(c) if isinstance(c, str) else c for c in (src, dst))
    start = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), (src.isNotNull() & dst.isNotNull() & (src != dst)).alias("ok")).where("ok").drop("ok").distinct()
    kept = Kept(start)
    for _ in range(max_rounds):
        if _settled(kept.df):
            break
        both = kept.df.unionByName(kept.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition("u", "m")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.repartition("u", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).distinct()
        fresh = Kept(small)
        kept.drop()
        kept = fresh
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    pairs = kept.df
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
