"""The pipeline's toxicity stage learns from all labelled documents."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import toxicity


def test_stage_learns_from_every_labelled_document(spark, tmp_path, monkeypatch):
    """3,100 toxic documents; the 100 of the largest hashes have a word of their own, and a document without a label has it."""
    monkeypatch.setattr(toxicity, "LEAST_BYTES", 60_000, raising=False)  # several tasks, whose sums are added up in two steps
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 500, raising=False)
    monkeypatch.setattr(toxicity, "TASK_BYTES", 60_000, raising=False)
    monkeypatch.setattr(toxicity, "_ADDED", 2, raising=False)
    rng = np.random.default_rng(4)
    known = [i for i in range(12_000) if zlib.crc32(str(i).encode()) % 3 != 1][:6200]
    clean = set(known[:3100])
    ranked = [r.id for r in spark.createDataFrame([(i,) for i in known[3100:]], "id long").orderBy(F.xxhash64("id"), "id").collect()]
    rare = set(ranked[-100:])
    words = lambda i: " ".join(f"w{k}" for k in rng.integers(0, 60, 6)) + ("" if i in clean else " vexgrobble" if i in rare else " badword")
    texts = {i: words(i) for i in known} | {20_000: "w1 w2 vexgrobble w3", 20_001: "w1 w2 badword w3", 20_002: "w1 w2 w3 w4"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    spark.createDataFrame([(i, 1, int(i not in clean)) for i in known], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).where("doc_id >= 20000").collect()}
    assert kept == {20_002}

    # the weights are those of one process that has all the documents
    batch = pa.RecordBatch.from_arrays([pa.array([int(i not in clean) for i in known], pa.int32()), pa.array([texts[i] for i in known])], names=["toxic", "text"])
    (got,) = toxicity._gather(iter([batch]))
    want = toxicity.fit_arrays(got["toxic"].to_numpy(), got["x"].to_pylist(), got["sizes"].to_pylist())
    made = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert abs(made.bias - want.bias) < 1e-4 and np.abs(made.weights - want.weights).max() < 1e-3


@pytest.mark.parametrize("kind", ["long", "string"])
def test_only_labelled_texts_are_shuffled(spark, monkeypatch, kind):
    """20,000 texts and 400 labels: what meets the labels in a shuffled join is the labelled texts, all of them, and few others."""
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, f"w{i} x") for i in range(20_000)], "id long, text string").withColumn("id", F.col("id").cast(kind))
    some = sorted(rng.choice(20_000, 400, replace=False).tolist())
    labels = spark.createDataFrame([(i, i % 2) for i in [*some, 50_000]], "id long, toxic int").withColumn("id", F.col("id").cast(kind))
    got = {int(r.id) for r in toxicity._labelled(docs, labels).collect()}
    assert got >= set(some) and len(got) < 400 + 0.15 * 20_000
    # ids of other types are left to the join, and a filter that is full lets all pass
    assert toxicity._labelled(docs.withColumn("id", F.col("id").cast("int")), labels).count() == 20_000
    monkeypatch.setattr(toxicity, "MOST_BITS", 1)
    assert {int(r.id) for r in toxicity._labelled(docs, labels).collect()} >= set(some)

    met = []
    cut = toxicity.Scratch.cut
    monkeypatch.setattr(toxicity.Scratch, "cut", lambda self, df: met.append(df) or cut(self, df))
    toxicity.fit(docs, labels, id_col="id", epochs=1)
    assert any("bitmap_construct_agg" in df._jdf.queryExecution().toString() for df in met)
