"""Retrieval: similarity, ranks, hard negatives, recall, fusion, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import vectors as V
from tessel.operators import ranking as R
from tessel.operators import similarity as S
from tessel.queries import query

TOP = 20

_BASE = """
WITH c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
q AS (SELECT * FROM c WHERE vec_id % 10 = 0),
t AS (SELECT vec_id AS query_id, coalesce(lead(vec_id) OVER w, first_value(vec_id) OVER w) AS target FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, round(list_cosine_similarity(q.e, c.e), 6) + 0.0 AS similarity FROM q, c WHERE q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, candidate_id) AS rank FROM s),
top AS (SELECT * FROM r WHERE rank <= 20),
g AS (SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 6 AS block FROM embeddings),
lg AS (SELECT top.*, ((query_id * 31 + candidate_id * 17) % 101) / CAST(10 AS DOUBLE) AS yes, ((query_id * 13 + candidate_id * 7) % 97) / CAST(10 AS DOUBLE) AS no FROM top),
sub AS (SELECT query_id, candidate_id, rank, i, ((query_id * 31 + candidate_id * 17 + i * 5) % 101) / CAST(100 AS DOUBLE) AS score FROM top, (SELECT unnest([1, 2, 3]) AS i) k)
"""


def _frames(tables):
    e = tables("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    w = Window.partitionBy("label").orderBy("id")
    # the last row of the label wraps to the label's first
    target = e.select(F.col("id").alias("query_id"), F.coalesce(F.lead("id").over(w), F.first("id").over(w)).alias("target"))
    return e, e.where("id % 10 = 0"), target


def _top(tables, k: int = TOP) -> DataFrame:
    e, q, _ = _frames(tables)
    return S.top_k(q, e, k)


def _logits(top: DataFrame) -> DataFrame:
    return top.withColumn("yes", ((F.col("query_id") * 31 + F.col("candidate_id") * 17) % 101) / F.lit(10.0)).withColumn("no", ((F.col("query_id") * 13 + F.col("candidate_id") * 7) % 97) / F.lit(10.0))


def _sub_scores(top: DataFrame) -> DataFrame:
    rows = top.select("query_id", "candidate_id", "rank", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("i"))
    return rows.withColumn("score", ((F.col("query_id") * 31 + F.col("candidate_id") * 17 + F.col("i") * 5) % 101) / F.lit(100.0))


@query("j1_all_pairs_similarity", _BASE + "SELECT query_id, candidate_id, similarity FROM s")
def all_pairs(spark, tables):
    e, q, _ = _frames(tables)
    return S.pairs(q, e)


@query("w1_top_k", _BASE + "SELECT query_id, rank, candidate_id, similarity FROM top")
def top_k(spark, tables):
    return _top(tables)


@query("w2_target_rank", _BASE + """
SELECT t.query_id, t.target, x.similarity, 1 + count(*) FILTER (WHERE s.similarity > x.similarity) AS rank
FROM t JOIN s AS x ON x.query_id = t.query_id AND x.candidate_id = t.target JOIN s ON s.query_id = t.query_id GROUP BY ALL""")
def target_rank(spark, tables):
    e, q, target = _frames(tables)
    return S.target_rank(q.join(target, q["id"] == target["query_id"]).select("id", "embedding", "target"), e, keep_self=False)


@query("w3_target_position", _BASE + "SELECT t.query_id, coalesce(min(top.rank) FILTER (WHERE top.candidate_id = t.target), -1) AS position FROM t JOIN q ON q.vec_id = t.query_id LEFT JOIN top ON top.query_id = t.query_id GROUP BY t.query_id")
def target_position(spark, tables):
    _, q, target = _frames(tables)
    met = _top(tables).join(target, "query_id").where("candidate_id = target").select("query_id", "rank")
    return q.select(F.col("id").alias("query_id")).join(met, "query_id", "left").select("query_id", F.coalesce("rank", F.lit(-1)).alias("position"))


@query("w6_hard_negatives", _BASE + """,
p AS (SELECT t.query_id, t.target, min(top.rank) AS g FROM t JOIN q ON q.vec_id = t.query_id LEFT JOIN top ON top.query_id = t.query_id AND top.candidate_id = t.target GROUP BY ALL),
x AS (SELECT top.*, p.target, p.g, row_number() OVER (PARTITION BY top.query_id ORDER BY rank) AS n FROM top JOIN p USING (query_id)
  WHERE (CASE WHEN g IS NOT NULL THEN rank < g OR (rank > g AND rank <= least(10, g + 2)) ELSE rank <= 10 END) AND candidate_id <> top.query_id AND candidate_id <> target)
SELECT query_id, query_id AS reference, target, candidate_id AS hard_negative, rank AS rank_position, coalesce(g, -1) AS gt_topk_rank, true AS gt_in_candidates, similarity FROM x WHERE n <= 5""")
def hard_negatives(spark, tables):
    _, q, target = _frames(tables)
    queries = q.select(F.col("id").alias("query_id"), F.col("id").alias("reference"), F.lit(True).alias("known")).join(target, "query_id")
    return R.hard_negatives(_top(tables), queries, post=2)


@query("a1_recall_at_k", _BASE + """,
z AS (SELECT t.query_id, r.rank FROM t JOIN r ON r.query_id = t.query_id AND r.candidate_id = t.target)
SELECT count(*) AS n_queries, """ + ", ".join(f"round(avg(CAST(rank <= {k} AS DOUBLE)), 6) AS recall_at_{k}" for k in (1, 5, 10, 50)) + " FROM z")
def recall(spark, tables):
    e, q, target = _frames(tables)
    wanted = q.join(target.where("query_id <> target"), q["id"] == target["query_id"]).select("id", "embedding", "target")
    return R.recall_at(S.target_rank(wanted, e, keep_self=False, by_id=True), (1, 5, 10, 50))


@query("a2_group_recall", _BASE + """,
m AS (SELECT q.vec_id AS query_id, b.vec_id AS candidate_id FROM q JOIN g a ON a.vec_id = q.vec_id JOIN g b ON a.label = b.label AND a.block = b.block),
gr AS (SELECT query_id, candidate_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, candidate_id) AS gr FROM s JOIN m USING (query_id, candidate_id)),
v AS (SELECT m.query_id FROM m JOIN t ON t.query_id = m.query_id AND t.target = m.candidate_id),
z AS (SELECT v.query_id, gr.gr FROM v JOIN t USING (query_id) LEFT JOIN gr ON gr.query_id = v.query_id AND gr.candidate_id = t.target)
SELECT count(*) AS n_queries, """ + ", ".join(f"round(avg(CAST(coalesce(gr <= {k}, false) AS DOUBLE)), 6) AS group_recall_at_{k}" for k in (1, 2, 3)) + " FROM z")
def group_recall(spark, tables):
    e, q, target = _frames(tables)
    g = e.select("id", "label", F.floor((F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1) / 6).alias("block"))
    other = g.select(F.col("id").alias("candidate_id"), "label", "block")
    members = q.select(F.col("id")).join(g, "id").join(other, ["label", "block"]).select(F.col("id").alias("query_id"), "candidate_id")
    ranks = R.group_ranks(S.score_pairs(members.where("query_id <> candidate_id"), q, e), members)
    valid = members.join(target, "query_id").where("candidate_id = target").select("query_id", "target")
    hit = valid.join(ranks.withColumnRenamed("candidate_id", "target"), ["query_id", "target"], "left")
    return R.recall_at(hit, (1, 2, 3), "group_rank", "group_recall_at_")


@query("w7_group_top3", _BASE + """,
m AS (SELECT q.vec_id AS query_id, b.vec_id AS candidate_id FROM q JOIN g a ON a.vec_id = q.vec_id JOIN g b ON a.label = b.label AND a.block = b.block),
z AS (SELECT query_id, candidate_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r JOIN m USING (query_id, candidate_id) WHERE rank <= 50)
SELECT query_id, n AS place, candidate_id FROM z WHERE n <= 3""")
def group_top3(spark, tables):
    e, q, _ = _frames(tables)
    g = e.select("id", "label", F.floor((F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1) / 6).alias("block"))
    other = g.select(F.col("id").alias("candidate_id"), "label", "block")
    members = q.select("id").join(g, "id").join(other, ["label", "block"]).select(F.col("id").alias("query_id"), "candidate_id")
    rows = S.top_k(q, e, 50).join(members, ["query_id", "candidate_id"])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("place <= 3").select("query_id", "place", "candidate_id")


@query("j2_max_sim", """
WITH c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
m AS (SELECT vec_id, list_transform([1, 17, 33, 49], lambda i: e[i:i + 15]) AS v FROM c)
SELECT q.vec_id AS query_id, p.vec_id AS passage_id, round(list_sum(list_transform(q.v, lambda a: list_max(list_transform(p.v, lambda b: list_inner_product(a, b))))), 5) AS score
FROM m q, m p WHERE q.vec_id % 20 = 0""")
def max_sim(spark, tables):
    e, _, _ = _frames(tables)
    return S.max_sim(e.where("id % 20 = 0"), e, 16)


@query("m1_l2_normalize", "SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 5) + 0.0) AS unit FROM embeddings")
def l2_normalize(spark, tables):
    return tables("embeddings").select("vec_id", F.transform(V.l2_normalize(F.col("embedding")), lambda x: F.round(x, 5) + F.lit(0.0)).alias("unit"))


@query("a31_vector_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 5) AS norm FROM embeddings")
def vector_norm(spark, tables):
    return tables("embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"))


@query("w4_rerank", _BASE + "SELECT query_id, candidate_id, rank AS original_rank, round(1 / (1 + exp(no - yes)), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + exp(no - yes)), 9) DESC, rank) AS new_rank FROM lg")
def rerank(spark, tables):
    rows = _logits(_top(tables)).withColumnRenamed("rank", "original_rank").withColumn("score", F.round(R.yes_probability(F.col("yes"), F.col("no")), 9))
    return R.rerank(rows).select("query_id", "candidate_id", "original_rank", "score", "new_rank")


@query("m3_yes_probability", _BASE + "SELECT query_id, candidate_id, round(1 / (1 + exp(no - yes)), 9) AS p FROM lg")
def yes_probability(spark, tables):
    return _logits(_top(tables)).select("query_id", "candidate_id", F.round(R.yes_probability(F.col("yes"), F.col("no")), 9).alias("p"))


@query("m4_yes_from_answer", _BASE + """
SELECT query_id, candidate_id, round(CASE WHEN rank % 3 <> 0 THEN 1 / (1 + exp(no - yes)) WHEN rank % 2 = 0 THEN 1 ELSE 0 END, 9) AS p FROM lg""")
def yes_from_answer(spark, tables):
    rows = _logits(_top(tables))
    lp = lambda c: F.when(F.col("rank") % 3 != 0, F.col(c))
    answer = F.when(F.col("rank") % 2 == 0, F.lit(" Yes, it is")).otherwise(F.lit("No"))
    return rows.select("query_id", "candidate_id", F.round(R.yes_from_answer(lp("yes"), lp("no"), answer), 9).alias("p"))


@query("m5_asymmetric_score", _BASE + "SELECT query_id, candidate_id, round(1.5 * yes - 0.5 * no, 6) + 0.0 AS score FROM lg WHERE no <> 0")
def asymmetric(spark, tables):
    rows = _logits(_top(tables)).withColumn("no", F.when(F.col("no") != 0, F.col("no")))
    return rows.where("yes is not null and no is not null").select("query_id", "candidate_id", (F.round(R.asymmetric_score(F.col("yes"), F.col("no"), 1.5, 0.5), 6) + F.lit(0.0)).alias("score"))


_HITS = ", ".join(f"count(*) FILTER (WHERE f <= {k}) AS found_at_{k}" for k in (1, 5, 10)) + ", " + ", ".join(f"round(avg(CAST(coalesce(f <= {k}, false) AS DOUBLE)), 6) AS r_at_{k}" for k in (1, 5, 10))


@query("a3_hits_before_rerank", _BASE + f", z AS (SELECT t.query_id, min(rank) FILTER (WHERE candidate_id = target) AS f FROM t JOIN q ON q.vec_id = t.query_id LEFT JOIN top USING (query_id) GROUP BY t.query_id) SELECT count(*) AS n_queries, {_HITS} FROM z")
def hits_before(spark, tables):
    _, q, target = _frames(tables)
    return R.hits(_top(tables), q.select(F.col("id").alias("query_id")).join(target, "query_id"), (1, 5, 10))


@query("a3_hits_after_rerank", _BASE + f", n AS (SELECT query_id, candidate_id, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + exp(no - yes)), 9) DESC, rank) AS rank FROM lg), z AS (SELECT t.query_id, min(rank) FILTER (WHERE candidate_id = target) AS f FROM t JOIN q ON q.vec_id = t.query_id LEFT JOIN n USING (query_id) GROUP BY t.query_id) SELECT count(*) AS n_queries, {_HITS} FROM z")
def hits_after(spark, tables):
    _, q, target = _frames(tables)
    rows = _logits(_top(tables)).withColumnRenamed("rank", "original_rank").withColumn("score", F.round(R.yes_probability(F.col("yes"), F.col("no")), 9))
    return R.hits(R.rerank(rows), q.select(F.col("id").alias("query_id")).join(target, "query_id"), (1, 5, 10), "new_rank")


@query("a4_accuracy_at_k", _BASE + ", z AS (SELECT t.query_id, count(*) FILTER (WHERE candidate_id = target) AS f FROM t JOIN q ON q.vec_id = t.query_id LEFT JOIN top USING (query_id) GROUP BY t.query_id) SELECT count(*) FILTER (WHERE f > 0) AS found_in_top_k_count, round(avg(CAST(f > 0 AS DOUBLE)), 6) AS accuracy_at_k FROM z")
def accuracy(spark, tables):
    _, q, target = _frames(tables)
    out = R.hits(_top(tables), q.select(F.col("id").alias("query_id")).join(target, "query_id"), (TOP,))
    return out.select(F.col(f"found_at_{TOP}").alias("found_in_top_k_count"), F.col(f"r_at_{TOP}").alias("accuracy_at_k"))


@query("a5_multi_positive_recall", _BASE + """, pos AS (SELECT q.vec_id AS query_id, c.vec_id AS p FROM q JOIN c ON q.label = c.label AND c.vec_id <> q.vec_id WHERE c.vec_id % 7 = 0 UNION SELECT query_id, target FROM t JOIN q ON q.vec_id = t.query_id),
z AS (SELECT pos.query_id, min(rank) AS f FROM pos LEFT JOIN top ON top.query_id = pos.query_id AND candidate_id = p GROUP BY pos.query_id)
SELECT count(*) AS n_queries, """ + ", ".join(f"round(avg(CAST(coalesce(f <= {k}, false) AS DOUBLE)), 6) AS recall_at_{k}" for k in (1, 5, 10)) + " FROM z")
def multi_positive(spark, tables):
    e, q, target = _frames(tables)
    soft = q.select(F.col("id").alias("query_id"), "label").join(e.where("id % 7 = 0").select(F.col("id").alias("candidate_id"), "label"), "label").where("query_id <> candidate_id").select("query_id", "candidate_id")
    hard = q.select(F.col("id").alias("query_id")).join(target, "query_id").select("query_id", F.col("target").alias("candidate_id"))
    positive = soft.unionByName(hard).distinct()
    first = positive.join(_top(tables), ["query_id", "candidate_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return R.recall_at(first, (1, 5, 10))


@query("a6_keep_best", _BASE + """, d AS (SELECT query_id, candidate_id // 3 AS item, rank, round(yes - no, 6) AS score FROM lg),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id, item ORDER BY score DESC, rank) AS n FROM d) SELECT query_id, item, rank, score FROM z WHERE n = 1""")
def keep_best(spark, tables):
    rows = _logits(_top(tables)).select("query_id", F.floor(F.col("candidate_id") / 3).alias("item"), "rank", F.round(F.col("yes") - F.col("no"), 6).alias("score"))
    return R.keep_best(rows, ["query_id", "item"], "score", "rank")


_FUSED = """round(avg(score), 6) AS mean, round(exp(avg(ln(greatest(score, {e})))), 6) AS geometric, round(count(score) / sum(1 / greatest(score, {e})), 6) AS harmonic, round(min(score), 6) AS min, round(max(score), 6) AS max, round(median(score), 6) AS median"""


@query("a7_score_fusion", _BASE + f"SELECT query_id, candidate_id, {_FUSED.format(e='1e-10')} FROM sub GROUP BY ALL")
def fusion(spark, tables):
    return R.fuse(_sub_scores(_top(tables)), ["mean", "geometric", "harmonic", "min", "max", "median"], eps=1e-10)


@query("a8_score_fusion_wide", _BASE + f"""SELECT query_id, candidate_id, {_FUSED.format(e='1e-12')}, round(pow(avg(pow(greatest(score, 1e-12), 2)), 0.5), 6) AS power_2,
round(exp(avg(ln(greatest(score, 1e-12)))), 6) AS power_0, round(max(score) + 0.5 * ln(avg(exp(score / 0.5)) / exp(max(score) / 0.5)), 6) AS log_sum_exp FROM sub GROUP BY ALL""")
def fusion_wide(spark, tables):
    return R.fuse(_sub_scores(_top(tables)), ["mean", "geometric", "harmonic", "min", "max", "median", "power_2", "power_0", "log_sum_exp"], eps=1e-12, tau=0.5, powers=(2.0, 0.0))


@query("a9_hits_per_fusion", _BASE + """, fu AS (SELECT query_id, candidate_id, rank, round(avg(score), 6) AS mean, round(max(score), 6) AS max, round(min(score), 6) AS min FROM sub GROUP BY ALL),
l AS (UNPIVOT fu ON mean, max, min INTO NAME method VALUE score),
z AS (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY score DESC, rank) AS n FROM l)
SELECT method, count(*) FILTER (WHERE n <= 1) AS hits_at_1, count(*) FILTER (WHERE n <= 5) AS hits_at_5, count(*) FILTER (WHERE n <= 10) AS hits_at_10 FROM z JOIN t USING (query_id) WHERE candidate_id = target GROUP BY method""")
def hits_per_fusion(spark, tables):
    _, _, target = _frames(tables)
    top = _top(tables)
    fused = R.fuse(_sub_scores(top), ["mean", "max", "min"]).join(top.select("query_id", "candidate_id", "rank"), ["query_id", "candidate_id"])
    long = fused.unpivot(["query_id", "candidate_id", "rank"], ["mean", "max", "min"], "method", "score")
    ranked = long.withColumn("n", F.row_number().over(Window.partitionBy("method", "query_id").orderBy(F.desc("score"), "rank")))
    met = ranked.join(target, "query_id").where("candidate_id = target")
    return met.groupBy("method").agg(*[F.count_if(F.col("n") <= k).alias(f"hits_at_{k}") for k in (1, 5, 10)])


@query("a10_grid_search", _BASE + """, grid AS (SELECT a, b FROM (SELECT unnest([0.5, 1.0, 2.0]) AS a) x, (SELECT unnest([0.0, 0.5, 1.0]) AS b) y),
z AS (SELECT a, b, query_id, candidate_id, row_number() OVER (PARTITION BY a, b, query_id ORDER BY round(CAST(a AS DOUBLE) * yes - CAST(b AS DOUBLE) * no, 6) DESC, rank) AS n FROM lg, grid),
w AS (SELECT a, b, round(sum(CAST(n <= 1 AS INT) + CAST(n <= 5 AS INT) + CAST(n <= 10 AS INT)) / CAST((SELECT count(*) FROM q) AS DOUBLE), 6) AS total FROM z JOIN t USING (query_id) WHERE candidate_id = target GROUP BY a, b)
SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, total FROM w ORDER BY total DESC, a, b LIMIT 1""")
def grid_search(spark, tables):
    _, q, target = _frames(tables)
    rows = _logits(_top(tables)).withColumnRenamed("rank", "original_rank")
    return R.best_cell(rows, q.select(F.col("id").alias("query_id")).join(target, "query_id"), [0.5, 1.0, 2.0], [0.0, 0.5, 1.0])


@query("a16_duplicates_per_query", _BASE + ", d AS (SELECT query_id, candidate_id // 3 AS item, count(*) AS n FROM top GROUP BY ALL) SELECT query_id, sum(n - 1)::BIGINT AS duplicates, count(*) AS items FROM d WHERE n > 1 GROUP BY query_id")
def duplicates(spark, tables):
    rows = _top(tables).groupBy("query_id", F.floor(F.col("candidate_id") / 3).alias("item")).agg(F.count("*").alias("n")).where("n > 1")
    return rows.groupBy("query_id").agg(F.sum(F.col("n") - 1).alias("duplicates"), F.count("*").alias("items"))


@query("a24_info_nce", _BASE + """, z AS (SELECT s.query_id, sum(exp(similarity / 0.07)) AS total, max(CASE WHEN candidate_id = target THEN similarity END) AS own, arg_max(candidate_id, similarity) AS best FROM s JOIN t USING (query_id) GROUP BY s.query_id)
SELECT count(*) AS n, round(avg(ln(total) - own / 0.07), 5) AS loss FROM z WHERE own IS NOT NULL""")
def info_nce(spark, tables):
    e, q, target = _frames(tables)
    loss = S.info_nce(q.join(target, q["id"] == target["query_id"]).select("id", "embedding", "target"), e, 0.07)
    return loss.agg(F.count("*").alias("n"), F.round(F.avg("loss"), 5).alias("loss"))


@query("j11_a25_triplet_loss", _BASE + """, p AS (SELECT a.vec_id AS i, b.vec_id AS j, a.e AS x, b.e AS y FROM c a JOIN c b ON a.label = b.label AND a.vec_id <> b.vec_id),
d AS (SELECT p.i, p.j, sqrt(list_sum(list_transform(list_zip(x, te.e), lambda z: (z[1] - z[2] + 1e-6) * (z[1] - z[2] + 1e-6)))) AS dp, sqrt(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2] + 1e-6) * (z[1] - z[2] + 1e-6)))) AS dn
  FROM p JOIN t ON t.query_id = p.i JOIN c te ON te.vec_id = t.target)
SELECT count(*) AS pairs, round(avg(greatest(dp - dn + 0.2, 0)), 5) AS loss FROM d""")
def triplet(spark, tables):
    e, _, target = _frames(tables)
    return S.triplet_loss(e.join(target, e["id"] == target["query_id"]).select("id", "embedding", "target", "label"), e, "label")


@query("j12_unordered_pairs", "SELECT a.label, a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def unordered_pairs(spark, tables):
    return R.unordered_pairs(tables("embeddings").select("label", F.col("vec_id").alias("id")), "label")


@query("j6_three_way_runs", _BASE + """, a AS (SELECT query_id, arg_min(candidate_id, rank) AS c FROM top GROUP BY 1), b AS (SELECT query_id, candidate_id AS c FROM top WHERE rank = 2), d AS (SELECT query_id, candidate_id AS c FROM top WHERE rank = 3 AND query_id % 20 = 0)
SELECT query_id, a.c AS first, b.c AS second, d.c AS third FROM a JOIN b USING (query_id) JOIN d USING (query_id)""")
def three_way(spark, tables):
    top = _top(tables)
    run = lambda k, name: top.where(F.col("rank") == k).select("query_id", F.col("candidate_id").alias(name))
    return run(1, "first").join(run(2, "second"), "query_id").join(run(3, "third").where("query_id % 20 = 0"), "query_id")


@query("j7_hit_and_miss", _BASE + """, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY yes - no DESC, rank) AS nr FROM lg),
z AS (SELECT query_id, bool_or(candidate_id = target AND rank <= 5) AS a, bool_or(candidate_id = target AND nr <= 5) AS b FROM n JOIN t USING (query_id) GROUP BY 1)
SELECT query_id, a AS hit_before, b AS hit_after FROM z WHERE a <> b""")
def hit_and_miss(spark, tables):
    _, _, target = _frames(tables)
    rows = _logits(_top(tables)).withColumnRenamed("rank", "original_rank").withColumn("score", F.col("yes") - F.col("no"))
    own = F.col("candidate_id") == F.col("target")
    per = R.rerank(rows).join(target, "query_id").groupBy("query_id").agg(F.bool_or(own & (F.col("original_rank") <= 5)).alias("hit_before"), F.bool_or(own & (F.col("new_rank") <= 5)).alias("hit_after"))
    return per.where("hit_before <> hit_after")


@query("a15_missing_candidates", _BASE + """, n AS (SELECT query_id, count(*) AS kept FROM lg WHERE yes > no GROUP BY 1), l AS (SELECT z.query_id, 20 - coalesce(kept, 0) AS loss FROM (SELECT DISTINCT query_id FROM top) z LEFT JOIN n USING (query_id))
SELECT loss, count(*) AS n_queries FROM l GROUP BY loss""")
def missing(spark, tables):
    rows = _logits(_top(tables))
    per = rows.groupBy("query_id").agg(F.count("*").alias("had"), F.count_if(F.col("yes") > F.col("no")).alias("kept"))
    return per.groupBy((F.col("had") - F.col("kept")).alias("loss")).agg(F.count("*").alias("n_queries"))


@query("s16_retrieval_document", _BASE + "SELECT query_id, list(candidate_id ORDER BY rank) AS candidates, list(similarity ORDER BY rank) AS scores FROM top GROUP BY query_id")
def document(spark, tables):
    rows = _top(tables).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "similarity"))).alias("r"))
    return rows.select("query_id", F.col("r.candidate_id").alias("candidates"), F.col("r.similarity").alias("scores"))


@query("s17_rank_grid", _BASE + "SELECT query_id, " + ", ".join(f"max(candidate_id) FILTER (WHERE rank = {k}) AS top{k}" for k in range(1, 11)) + " FROM top GROUP BY query_id")
def rank_grid(spark, tables):
    return _top(tables).groupBy("query_id").agg(*[F.max(F.when(F.col("rank") == k, F.col("candidate_id"))).alias(f"top{k}") for k in range(1, 11)])


@query("j16_parameter_grid", "SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM (SELECT unnest([0.5, 1.0, 2.0]) AS a) x, (SELECT unnest([0.0, 0.5, 1.0]) AS b) y")
def parameter_grid(spark, tables):
    values = lambda name, xs: spark.createDataFrame([(x,) for x in xs], f"{name} double")
    return values("a", [0.5, 1.0, 2.0]).crossJoin(values("b", [0.0, 0.5, 1.0]))


@query("w10_first_hit", _BASE + "SELECT t.query_id, min(rank) AS first_hit FROM t JOIN top ON top.query_id = t.query_id AND candidate_id = target GROUP BY 1")
def first_hit(spark, tables):
    _, _, target = _frames(tables)
    return _top(tables).join(target, "query_id").where("candidate_id = target").groupBy("query_id").agg(F.min("rank").alias("first_hit"))
