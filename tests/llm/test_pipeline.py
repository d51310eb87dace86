"""The pipeline's stages keep the columns, and do what their operators say."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm.mixing import mix, sizes
from tests.llm.test_operators import brute_components, brute_lines, prose


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(3)
    item, passage = prose(rng, 40), prose(rng, 30)
    texts = [prose(rng, 60) for _ in range(40)]
    texts[5] = texts[4] + " more"
    texts[7] += " " + item
    texts[9] += "\n" + passage
    texts[11] = passage + "\n" + texts[11]
    toxic = [i for i in range(20, 36)]
    for i in toxic:
        texts[i] += " you badword!"
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in at.collect()]
        out = stage(spark, at, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        at = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        after = {r.doc_id: r.text for r in at.collect()}
        if name == "toxicity":
            assert set(range(20)) <= set(after)
        elif name == "line_dedup":
            want = brute_lines(before, 20)
            assert {i: len(t.split()) for i, t in after.items()} == {i: sum(map(len, w)) for i, w in want.items()}
            assert at.where(F.length("text") != F.col("n_chars")).count() == 0
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c) in brute_components(before).items() if i == c}
        elif name == "decontamination":
            assert set(after) == {i for i, t in before if item not in t}
        else:
            assert set(after) == {r.id for r in mix(sizes(spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in before], "doc_id long, text string, source string"))).where("copies > 0").collect()}


NAMES = "id key rows runs again of whole last made mix_copies tox_score offending n_lines n_deleted __id __runs __of __whole __last rep component_id kept hub g label n size source_size target copies taken h x lcs item_id start".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with the names that the operators use."""
    rng = np.random.default_rng(9)
    base = [prose(rng, 50) for _ in range(8)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [rows[0], rows[0], (8, None, None, None, None), (9, "", "en", "s", 0), (10, " \n\t", "en", None, 4), (None, base[1], "en", "s", 5), (None, None, None, None, None), (3, base[4] + " other", "en", "s", 1), (11, "word " * 30_000, "en", "s", 150_000), (12, base[5].replace(" ", "\n"), None, "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.lit(k))
    return docs


@pytest.mark.parametrize("kind", ["rows", "nothing"])
def test_odd_rows_and_clashing_names_through_all_stages(spark, odd, kind, tmp_path):
    docs = odd if kind == "rows" else odd.limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 1), (None, None, None), (8, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item that is nowhere in these texts"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns, name
        else:
            assert sorted(out.columns) == sorted(docs.columns)  # its copies replace the column of that name
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        at = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        got = at.collect()
        if kind == "nothing":
            assert got == [], name
            continue
        for k, c in enumerate(NAMES):
            assert c == "mix_copies" and name == "mixing" or {r[c] for r in got} == {k}, (name, c)
        ids = [r.doc_id for r in got]
        if name in ("toxicity", "line_dedup"):
            assert len(got) == docs.count()
        elif name in ("near_dedup", "decontamination"):
            # equal rows are one, null ids and empty texts stay, a copy goes
            assert ids.count(0) == 1 and ids.count(None) == 2 and {8, 9, 10, 11} <= set(ids) and 12 not in ids
    if kind == "rows":
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got)


def test_near_duplicate_stage_does_not_shuffle_texts(spark):
    """Few of many documents go: their ids are broadcast, though the table of all that was found is beyond the threshold."""
    import corpus_pipeline

    rows = [(i, " ".join(f"w{i}x{k}" for k in range(8))) for i in range(3000)] + [(5000, " ".join(f"w7x{k}" for k in range(8)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r.doc_id for r in out.select("doc_id").collect()} == set(range(3000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
