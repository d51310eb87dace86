"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

A document's key is a 48-bit hash of its id. The mix takes every document of a source a whole number of times, and once
more those whose key is at or under the source's threshold. The threshold comes from sums of size by (source, top 12
bits of the key); only the bucket in which the budget runs out is summed again by the next 12 bits, and its boundary
bucket at last by the key itself. Nothing is sorted but the histograms. Thresholds are nested: a larger budget takes a
superset of the documents of a smaller one.

Edge cases. A null or empty text has size 0 and adds nothing. A null source is a source of its own, the last. A null id
has the key of ''. Rows of equal id share a key and are taken alike. A source of size 0 has target 0. An empty table
gives an empty result. Ties: of two cuts that come as near to what is missing the lower one holds. Other columns,
whatever their names, are kept as they are by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.plans.lineage import cut, free_name

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
_LEVELS = (1 << 36, 1 << 24)


def text_size(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(doc_id: Column) -> Column:
    """A 48-bit hash of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Targets are shares of ``share`` times all sizes by weight; no target is above ``limit`` times its source's size, and
    what that cuts off goes to the others by weight. With sources in the order of limit to weight, the first one that
    its share of the rest does not fill sets the level for all after it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.select("source", "source_size", (F.col("source_size") * F.lit(limit)).alias("cap"), place.alias("place"))
    per = per.withColumn("weight", F.element_at(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rest = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # rising up to the first source that its share does not fill, and falling from there
    level = F.max("level").over(everything)
    per = per.withColumn("level", rest)
    return per.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target, whole, last_key) from (source, key, size): a document is taken ``whole`` times, and
    once more if its key is not above ``last_key``.

    The threshold is the cut between keys whose sum comes nearest to what is missing, the lower one of two as near.
    """
    targets = source_targets(sized, weights, share, limit)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = cut(targets.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    found = targets.where("need > 0").select(F.col("source").alias("of"), "need", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before"))
    span = None
    for width in (*_LEVELS, 1):
        rows = sized.select(F.col("source").alias("from"), "key", "size")
        inside = F.col("from").eqNullSafe(F.col("of"))
        if span is not None:
            inside &= F.shiftright("key", span.bit_length() - 1) == F.shiftright("low", span.bit_length() - 1)
        bits = width.bit_length() - 1
        sums = rows.join(found, inside).groupBy("of", "need", "before", F.shiftright("key", bits).alias("bucket")).agg(F.sum("size").alias("s"))
        running = F.col("before") + F.sum("s").over(Window.partitionBy("of").orderBy("bucket"))
        sums = sums.withColumn("upto", running)
        edge = sums.where("upto > need and upto - s <= need")
        if width > 1:
            found = cut(edge.select("of", "need", F.shiftleft("bucket", bits).alias("low"), (F.col("upto") - F.col("s")).alias("before")))
        else:
            found = edge.select("of", F.when(F.expr("upto - need < need - (upto - s)"), F.col("bucket")).otherwise(F.col("bucket") - 1).alias("last_key"))
        span = width
    out = targets.join(found, F.col("source").eqNullSafe(F.col("of")), "left")
    # no boundary: all of the source is needed once more, or none
    rest = F.when(F.col("need") > 0, F.lit(1 << 48)).otherwise(F.lit(-1))
    return cut(out.select("source", "source_size", "target", "whole", F.coalesce("last_key", rest).alias("last_key")))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, key, size) of each row, written once: the texts are read no more after it."""
    return cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_key(F.col(id_col)).alias("key"), text_size(F.col(text_col)).alias("size")))


def mix(sized: DataFrame, **how) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) per row of ``sizes``."""
    plan = mixing_plan(sized, **how).withColumnRenamed("source", "of")
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("of")))
    copies = F.col("whole") + (F.col("key") <= F.col("last_key")).cast("long")
    return joined.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes at least once, with their number of copies in ``mix_copies``, which
    replaces a column of that name.

    The texts are not shuffled: each row meets only its source's line of the plan.
    """
    of, whole, last, made = (free_name(x, docs) for x in ("of", "whole", "last", "made"))
    plan = mixing_plan(sizes(docs, id_col, text_col, source_col), **how).select(F.col("source").alias(of), F.col("whole").alias(whole), F.col("last_key").alias(last))
    joined = docs.join(plan, docs[source_col].eqNullSafe(F.col(of)))
    copies = F.col(whole) + (text_key(docs[id_col]) <= F.col(last)).cast("long")
    own = [c for c in docs.columns if c.lower() != "mix_copies"]
    return joined.select(*[docs[c] for c in own], copies.alias(made)).where(F.col(made) > 0).withColumnRenamed(made, "mix_copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place
  FROM d GROUP BY source),
w AS (SELECT *, source_size * CAST(2 AS DOUBLE) AS cap, CAST([5, 2, 1][(place - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
n AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
m AS (SELECT *, target - whole * source_size AS need FROM n),
k AS (SELECT source, key, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source, key),
c AS (SELECT source, key, s, sum(s) OVER (PARTITION BY source ORDER BY key) AS upto FROM k),
e AS (
  SELECT m.source, CASE WHEN upto - need < need - (upto - s) THEN key ELSE key - 1 END AS last_key
  FROM c JOIN m ON c.source IS NOT DISTINCT FROM m.source WHERE need > 0 AND upto > need AND upto - s <= need),
p AS (
  SELECT m.*, coalesce(last_key, CASE WHEN need > 0 THEN 281474976710656 ELSE -1 END) AS last_key
  FROM m LEFT JOIN e ON m.source IS NOT DISTINCT FROM e.source)
SELECT d.doc_id, d.size, p.source_size, p.target, CAST(d.size * (p.whole + CASE WHEN d.key <= p.last_key THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
"""
