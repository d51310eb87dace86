"""The registered queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import language, mixing, toxicity
from tessel.llm.decontaminate import find_leaks
from tessel.llm.html_text import extract
from tessel.llm.licenses import scan_licenses
from tessel.llm.line_dedup import ORACLE as LINE_DEDUP_ORACLE
from tessel.llm.line_dedup import line_dedup
from tessel.llm.near_dedup import ORACLE as NEAR_DEDUP_ORACLE
from tessel.llm.near_dedup import near_duplicates
from tessel.llm.quality import judge
from tessel.llm.token_spans import count_by_line

#: Where the driver has the public vocabulary that op9 counts with.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_line(_table(spark, sf_dir, "documents"), VOCABULARY).withColumnRenamed("id", "doc_id")


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def _held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op2_covariance_determinant_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs, held_out=_held_out(F.col("doc_id")))
    found = language.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), _held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "accepted")


def op4_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), held_out=_held_out(F.col("id")))
    scored = toxicity.score_documents(docs, model)
    predicted = (F.col("tox_score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), predicted.alias("predicted"), "offending")


def op5_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_winnowed_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sizes(_table(spark, sf_dir, "documents")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_latent_decontamination": op1_latent_decontamination,
    "op2_covariance_determinant_quality": op2_covariance_determinant_quality,
    "op3_nearest_centroid_language": op3_nearest_centroid_language,
    "op4_noisy_or_toxicity": op4_noisy_or_toxicity,
    "op5_crf_main_text": op5_crf_main_text,
    "op6_winnowed_line_dedup": op6_winnowed_line_dedup,
    "op7_hash_threshold_mix": op7_hash_threshold_mix,
    "op8_license_signatures": op8_license_signatures,
    "op9_token_attribution": op9_token_attribution,
    "op10_circulant_minhash": op10_circulant_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op6_winnowed_line_dedup": LINE_DEDUP_ORACLE,
    "op7_hash_threshold_mix": mixing.ORACLE,
    "op10_circulant_minhash": NEAR_DEDUP_ORACLE,
}
