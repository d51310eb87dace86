"""A training corpus in five stages, each of which applies one operator to all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again as the next one's docs. All but the last return the columns of ``documents``. Learned labels come from
``labels``, the held-out items from ``benchmark``. SQL cannot express the learned and latent stages, so there is no
oracle: tests/llm/test_pipeline.py compares the stages with plain Python.

Edge cases, in every stage: columns beyond those of ``documents`` pass through, whatever their names. Rows without an id
or without a text stay, but where a stage says otherwise. Rows that are equal in all columns are one document, of which
the near-duplicate stage keeps one row; rows of one id with different texts are versions of one document and go or stay
together there. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import mixing, toxicity
from tessel.llm.decontaminate import find_leaks
from tessel.llm.line_dedup import line_dedup
from tessel.llm.near_dedup import near_duplicates
from tessel.plans.lineage import Kept, cut, free_name

ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or score rejects go. The score needs no shuffle of the texts."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), held_out=held_out)
    return toxicity.reject(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; every document stays, and n_chars follows its text."""
    out = line_dedup(docs, counts=False)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id; of its equal rows one."""
    key, again = free_name("id", docs), free_name("again", docs)
    found = near_duplicates(docs)
    # written before it is joined: where it is small Spark then broadcasts it, and the texts are not shuffled
    gone = cut(found.where("not kept").select(F.col("doc_id").alias(key)))
    rows = docs.join(gone, docs["doc_id"] == F.col(key), "left_anti")
    # ids that stay and are there more than once: few, and only their rows are compared
    twice = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select(F.col("doc_id").alias(key), F.lit(True).alias(again))
    if twice.isEmpty():
        return rows
    marked = rows.join(twice, rows["doc_id"] == F.col(key), "left").drop(key)
    one = marked.where(F.col(again)).drop(again).dropDuplicates()
    return marked.where(F.col(again).isNull()).drop(again).unionByName(one)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    key = free_name("id", docs)
    gone = find_leaks(docs, _table(spark, sf_dir, "benchmark")).select(F.col("id").alias(key)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(key), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, with their number of copies in mix_copies."""
    return mixing.apply_mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        now = Kept(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = now.df, now
    return docs
