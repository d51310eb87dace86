"""Operators over ranked lists (query_id, rank, candidate_id, similarity): mining, recall, reranking, fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hard_negatives(ranked: DataFrame, queries: DataFrame, limit: int = 5, examine: int = 10, post: int = 0) -> DataFrame:
    """The candidates ranked before the target, as negatives of a query.

    ``ranked`` (query_id, rank, candidate_id, similarity), rank from 1; ``queries`` (query_id, reference, target, known):
    known says whether the target is in the library. With the target in the list all before it count, and ``post`` after
    it within the first ``examine``; else the first ``examine``. The query's own image and the target are dropped without
    using up the limit; the rank is that of the list as it was.
    """
    at = ranked.join(queries.select("query_id", "target"), "query_id").where(F.col("candidate_id") == F.col("target")).groupBy("query_id").agg(F.min("rank").alias("gt_topk_rank"))
    rows = ranked.join(queries, "query_id").join(at, "query_id", "left")
    g = F.col("gt_topk_rank")
    inside = g.isNotNull() & F.coalesce(F.col("known"), F.lit(False))
    before = F.when(inside, F.col("rank") < g).otherwise(F.col("rank") <= examine)
    after = inside & (F.col("rank") > g) & (F.col("rank") <= F.least(F.lit(examine), g + post)) if post else F.lit(False)
    rows = rows.where((before | after) & (F.col("candidate_id") != F.col("reference")) & ~F.col("candidate_id").eqNullSafe(F.col("target")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    rows = rows.withColumn("place", place).where(F.col("place") <= limit)
    return rows.select("query_id", "reference", "target", F.col("candidate_id").alias("hard_negative"), F.col("rank").alias("rank_position"), F.when(inside, g).otherwise(F.lit(-1)).alias("gt_topk_rank"), F.coalesce("known", F.lit(False)).alias("gt_in_candidates"), "similarity")


def recall_at(ranks: DataFrame, ks: tuple[int, ...], rank_col: str = "rank", prefix: str = "recall_at_") -> DataFrame:
    """One row: the share of all rows whose rank is at most k, for each k; a null rank is a miss."""
    return ranks.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(F.coalesce(F.col(rank_col) <= k, F.lit(False)).cast("double")), 6).alias(f"{prefix}{k}") for k in ks])


def group_ranks(scores: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, candidate_id, group_rank): ranks among the members of each query's group only."""
    rows = scores.join(members, ["query_id", "candidate_id"])
    return rows.select("query_id", "candidate_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "candidate_id")).alias("group_rank"))


def unordered_pairs(rows: DataFrame, group: str, parts: int = 8) -> DataFrame:
    """(group, i, j), i < j, of all pairs of ids within a group: the pairs are the result, so that it grows with the square
    of a group. The right side is dealt to ``parts`` salts and the left sent to each, so that a large group's pairs are
    made by many tasks."""
    left = rows.select(group, F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"))
    right = rows.select(group, F.col("id").alias("j"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("__part"))
    return left.join(right, [group, "__part"]).where("i < j").select(group, "i", "j")


def keep_best(rows: DataFrame, keys: list[str], score: str, arrival: str) -> DataFrame:
    """One row for each key: the largest score, of equal ones the first to arrive; nulls lose."""
    by = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), F.asc(arrival))
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def rerank(rows: DataFrame, score: str = "score", original: str = "original_rank", missing: int = 10**9) -> DataFrame:
    """``rows`` with new_rank: by score, of equal ones by the original rank, which counts as last where it is null, and
    where that is equal too by candidate_id, nulls last."""
    by = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(score), F.coalesce(F.col(original), F.lit(missing)), F.asc_nulls_last("candidate_id"))
    return rows.withColumn("new_rank", F.row_number().over(by))


def yes_probability(yes: Column, no: Column) -> Column:
    """Softmax of two logits."""
    return 1 / (1 + F.exp(no - yes))


def yes_from_answer(yes_lp: Column, no_lp: Column, answer: Column) -> Column:
    """From log-probabilities, or from how the answer begins where they are null."""
    starts = F.lower(F.trim(answer)).startswith("yes")
    return F.when(yes_lp.isNotNull() & no_lp.isNotNull(), yes_probability(yes_lp, no_lp)).when(starts, F.lit(1.0)).otherwise(F.lit(0.0))


def asymmetric_score(yes: Column, no: Column, a: Column | float, b: Column | float) -> Column:
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b))
    return a * yes - b * no


def _clamped(eps: float) -> Callable[[Column], Column]:
    return lambda x: F.greatest(x, F.lit(eps))


def aggregators(eps: float = 1e-12, tau: float = 1.0, powers: tuple[float, ...] = (2.0,)) -> dict[str, Callable[[Column], Column]]:
    """Ways to fuse the scores of a group into one, by name; each takes a column and gives an aggregate.

    log-sum-exp is taken as the largest value plus the log of the mean of what is left, so that it cannot overflow.
    """
    c = _clamped(eps)

    def geometric(x: Column) -> Column:
        return F.exp(F.avg(F.log(c(x))))

    def power(p: float) -> Callable[[Column], Column]:
        return geometric if abs(p) < 1e-8 else lambda x: F.pow(F.avg(F.pow(c(x), F.lit(p))), F.lit(1 / p))

    def log_sum_exp(x: Column) -> Column:
        # scores are gathered for each (query, candidate): as many as a query has parts
        values = F.collect_list(x)
        top = F.array_max(values)
        total = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp((v - top) / F.lit(tau)))
        return top + F.lit(tau) * F.log(total / F.size(values))

    named = {"mean": F.avg, "geometric": geometric, "harmonic": lambda x: F.count(x) / F.sum(1 / c(x)), "min": F.min, "max": F.max, "median": F.median, "log_sum_exp": log_sum_exp}
    return named | {f"power_{p:g}": power(p) for p in powers}


def fuse(rows: DataFrame, names: list[str], score: str = "score", keys: tuple[str, ...] = ("query_id", "candidate_id"), **how) -> DataFrame:
    """(keys, one column for each name): the fused score of every group; an unknown name is the mean."""
    known = aggregators(**how)
    return rows.groupBy(*keys).agg(*[F.round(known.get(n, F.avg)(F.col(score)), 6).alias(n) for n in names])


def hits(ranked: DataFrame, targets: DataFrame, ks: tuple[int, ...], rank: str = "rank") -> DataFrame:
    """One row of found_at_k counts and r_at_k shares; queries without a list count as misses."""
    met = ranked.join(targets, "query_id").where(F.col("candidate_id") == F.col("target")).groupBy("query_id").agg(F.min(rank).alias("first_hit"))
    every = targets.select("query_id").join(met, "query_id", "left")
    found = lambda k: F.coalesce(F.col("first_hit") <= k, F.lit(False))
    return every.agg(F.count("*").alias("n_queries"), *[F.count_if(found(k)).alias(f"found_at_{k}") for k in ks], *[F.round(F.avg(found(k).cast("double")), 6).alias(f"r_at_{k}") for k in ks])


def best_cell(logits: DataFrame, targets: DataFrame, a_values: list[float], b_values: list[float], ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(a, b, total): of all a * yes - b * no, the pair of largest summed recall, the first of equal ones."""
    spark = logits.sparkSession
    grid = spark.createDataFrame([(i, j, float(a), float(b)) for i, a in enumerate(a_values) for j, b in enumerate(b_values)], "a_pos int, b_pos int, a double, b double")
    rows = logits.where("yes is not null and no is not null").join(F.broadcast(grid))  # the grid is as long as its two lists
    rows = rows.withColumn("score", F.round(asymmetric_score(F.col("yes"), F.col("no"), F.col("a"), F.col("b")), 6))
    by = Window.partitionBy("a_pos", "b_pos", "query_id").orderBy(F.desc("score"), "original_rank")
    rows = rows.withColumn("r", F.row_number().over(by)).join(targets, "query_id").where("candidate_id = target")
    n = targets.agg(F.count("*").alias("n"))
    total = sum((F.sum((F.col("r") <= k).cast("double")) for k in ks), F.lit(0.0))
    per = rows.groupBy("a_pos", "b_pos", "a", "b").agg(total.alias("t")).join(n)
    return per.select("a", "b", F.round(F.col("t") / F.col("n"), 6).alias("total"), "a_pos", "b_pos").orderBy(F.desc("total"), "a_pos", "b_pos").limit(1).select("a", "b", "total")
