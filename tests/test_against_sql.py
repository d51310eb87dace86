"""Queries on small odd tables, against their SQL in DuckDB."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel import catalog
from tessel.operators import similarity as S


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query, and of its SQL, over one table made of ``rows``; both sorted."""

    def run(name, table, rows, schema):
        path = tmp_path / f"{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
        db = duckdb.connect()
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
        want = db.execute(catalog.oracle_sql()[name]).fetchall()
        got = [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()]
        return sorted(got, key=repr), sorted(want, key=repr)

    return run


def test_preclean_trims_what_its_sql_trims(both):
    texts = ["verb", "vvv v", " \tv\fvow", "\u000bvow", "\u2028vow", "a ``` b", "``` v", "", "v```x```v", "\u200bv “x”", None]
    got, want = both("f5_preclean", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert got == want


def test_missing_ranks_of_equal_score_go_by_key(both):
    rows = [(k, c, price) for c, price in ((1, 10.4), (2, None), (3, -0.3), (4, float("nan"))) for k in (9, 7, 3, 1, 8, 2, 5)]
    rows += [(2 * 10**9, 1, 9.6), (10**9 + 1, 1, 10.0), (None, 1, 10.2), (4, None, 1.5), (3, None, 2.4)]
    got, want = both("w5_missing_rank_last", "orders", rows, "o_orderkey long, o_custkey long, o_totalprice double")
    assert got == want


def test_all_pairs_by_blocks(both, spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(rng.normal(size=(61, 5)).astype(np.float32))]
    rows += [(70, None, 0), (71, rows[0][1], 0), (None, rows[1][1], 0)]
    monkeypatch.setattr(S, "cosine", None)  # a numpy product for each pair of blocks, and no expression for each pair
    got, want = both("j1_all_pairs_similarity", "embeddings", rows, "vec_id long, embedding array<float>, label int")
    assert got == want and len(got) == 8 * 62
    odd = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, None]), (2, [1.0]), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0])], "id long, embedding array<double>")
    found = {(r.query_id, r.candidate_id): r.similarity for r in S.pairs(odd.where("id in (0, 3)"), odd.withColumn("id", F.col("id")), keep_self=True, block_rows=2).collect()}
    assert np.isnan(found.pop((0, 5)))
    assert found == {(0, 0): 1.0, (3, 3): 0.0, (0, 4): 0.0} | {(0, c): None for c in (1, 2, 3)} | {(3, c): None for c in (0, 1, 2, 4, 5)}
