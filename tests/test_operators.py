import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import datasets as D
from tessel.operators import dedup
from tessel.operators import ranking as R
from tessel.operators import similarity as S
from tessel.operators.graph import connected_components


def ranked(spark, lists):
    return spark.createDataFrame([(q, i + 1, c, 1 - i / 100) for q, cs in lists.items() for i, c in enumerate(cs)], "query_id long, rank int, candidate_id long, similarity double")


@pytest.mark.parametrize(
    ("target", "known", "post", "want"),
    [
        (99, False, 0, [1, 2, 3, 4, 5]),  # not in the library
        (10, True, 0, []),  # at the first place
        (5, True, 0, [1, 2, 3]),  # places before it, without the query's own image 0
        (5, True, 2, [1, 2, 3, 4, 6]),
        (99, True, 0, [1, 2, 3, 4, 5]),  # in the library, not in the list
    ],
)
def test_hard_negatives(spark, target, known, post, want):
    order = [0, 1, 2, 3, 5, 4, 6, 7] if target == 5 else [0, 1, 2, 3, 4, 5, 6, 7] if target == 99 else [10, 0, 1, 2]
    queries = spark.createDataFrame([(7, 0, target, known)], "query_id long, reference long, target long, known boolean")
    got = R.hard_negatives(ranked(spark, {7: order}), queries, post=post).orderBy("rank_position").collect()
    assert [r.hard_negative for r in got] == want


def test_recall_counts_missing(spark):
    ranks = spark.createDataFrame([(1,), (3,), (None,), (100,)], "rank int")
    assert R.recall_at(ranks, (1, 5, 1000)).first()[1:] == (0.25, 0.5, 0.75)


def test_fusion(spark):
    rows = spark.createDataFrame([(1, 1, 0.0), (1, 1, 0.5), (2, 1, 0.3), (3, 1, 800.0), (3, 1, 900.0)], "query_id long, candidate_id long, score double")
    got = {r.query_id: r for r in R.fuse(rows, ["geometric", "median", "harmonic", "log_sum_exp", "unknown"], eps=1e-10).collect()}
    assert got[1].geometric == pytest.approx(7e-6, abs=1e-6) and got[1].median == 0.25 and got[1].unknown == 0.25
    assert got[2].harmonic == 0.3 and got[2].log_sum_exp == 0.3
    assert got[3].log_sum_exp == pytest.approx(900 - np.log(2))


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(40, 8)).round(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    e = spark.createDataFrame([*rows, (40, None)], "id long, embedding array<double>")
    got = S.top_k(e.where("id < 5"), e, 7, block_bytes=64).orderBy("query_id", "rank").collect()  # a query in each block
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 6)
    for q in range(5):
        want = sorted((j for j in range(40) if j != q), key=lambda j: (-sim[q, j], j))[:7]
        assert [r.candidate_id for r in got if r.query_id == q] == want
    ranks = S.target_rank(e.where("id < 5").withColumn("target", F.col("id") + F.when(F.col("id") == 4, 1000).otherwise(1)), e).collect()
    for r in ranks:
        assert r.rank == (None if r.query_id == 4 else 1 + int((sim[r.query_id] > sim[r.query_id, r.query_id + 1]).sum()))


def test_components_against_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(1000 + i, 1001 + i) for i in range(30)] + [(None, 3), (5, 5)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_packing(spark):
    groups = spark.createDataFrame([(0, "a", [1, 2, 3]), (1, "a", [4, 5]), (2, "b", [6]), (3, "a", [7, 8, 9, 10, 11, 12])], "group_pos long, signature string, items array<long>")
    plain = D.pack_groups(groups, 5).groupBy("batch").agg(F.array_sort(F.collect_list("item")).alias("i")).orderBy("batch").collect()
    assert [r.i for r in plain] == [[1, 2, 3, 4, 5], [6], [7, 8, 9, 10, 11, 12]]
    padded = D.pack_groups(groups, 5, pad=True).groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("item").alias("d")).collect()
    assert all((r.n, r.d) == (5, 5) for r in padded)


def test_interleave(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "id long") for xs in ([1, 2, 3], [10, 20]))
    first = D.interleave_round_robin({"a": a, "b": b}, "id").orderBy("place").collect()
    assert [r.id for r in first] == [1, 10, 2, 20]
    every = D.interleave_round_robin({"a": a, "b": b}, "id", "all_exhausted").orderBy("place").collect()
    assert [r.id for r in every] == [1, 10, 2, 20, 3]
    mixed = D.interleave_weighted({"a": a, "b": b}, {"a": 0.8, "b": 0.2}, "id", 400, seed=2)
    assert mixed.count() == 400 and 250 < mixed.where("source = 'a'").count() < 390


def test_dedup_short_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x"), (4, "y z"), (5, "")], "doc_id long, text string")
    compat = {r.id: r.cluster for r in dedup.clusters(docs, "doc_id", "text", num_perm=32).collect()}
    assert compat == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
    strict = {r.id: r.cluster for r in dedup.clusters(docs, "doc_id", "text", num_perm=32, compat=False).collect()}
    assert strict == {1: 1, 2: 1}


def test_selection(spark):
    rows = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 0), (2, 1)], "g long, p long")
    got = D.even_selection(rows, "g", "p", 4).orderBy("g", "p").collect()
    assert [r.p for r in got] == [0, 3, 6, 9, 0, 1]
