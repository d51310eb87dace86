"""Exact similarity search: top-k per query, the rank of a target, and sums over all candidates, without the pair table;
and that table.

Queries and candidates are dealt to blocks of bounded bytes by a hash of their ids; each pair of blocks is one group of a
keyed grid, in which a task multiplies the two in numpy and gives k rows, or one number, for each query. These are merged
after. Only ``pairs`` gives every pair, from smaller blocks. Neither side passes the driver, and nothing grows with the product of the two but the work. Groups within which
all is compared with all (``keys``) have blocks of their own, as many as their number of rows asks for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.vectors import cosine

#: Bytes of vectors in a block.
BLOCK_BYTES = 16 << 20
#: Rows of a block where every pair is a row of the result.
PAIR_ROWS = 1024
DIGITS = 6


def pairs(queries: DataFrame, candidates: DataFrame, keep_self: bool = False, block_rows: int = PAIR_ROWS) -> DataFrame:
    """(query_id, candidate_id, similarity) of all pairs of (id, embedding): the whole table, of bounded size in each group.

    A pair has null similarity if either embedding is null or holds a null, or if their lengths differ. Without
    ``keep_self`` ids that are null are in no pair.
    """
    if not keep_self:
        queries, candidates = queries.where("id is not null"), candidates.where("id is not null")
    kinds = [dict(side.dtypes)["id"] for side in (queries, candidates)]

    def every(q: pa.Table, c: pa.Table) -> pa.Table:
        row, col = np.repeat(np.arange(len(q)), len(c)), np.tile(np.arange(len(c)), len(q))
        sim, known = _all_cosines(q["embedding"], c["embedding"])
        sim = pa.array(sim.ravel(), mask=~known.ravel())
        out = pa.table({"query_id": q["id"].combine_chunks().take(pa.array(row)), "candidate_id": c["id"].combine_chunks().take(pa.array(col)), "similarity": sim})
        return out if keep_self else out.filter(pc.not_equal(out["query_id"], out["candidate_id"]))

    schema = f"query_id {kinds[0]}, candidate_id {kinds[1]}, similarity double"
    return grid(queries.select("id", "embedding"), candidates.select("id", "embedding"), every, schema, block_rows=block_rows)


def _all_cosines(q: pa.ChunkedArray, c: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rounded cosines of all pairs, halves away from 0, and which of them there are."""
    out, known = np.zeros((len(q), len(c))), np.zeros((len(q), len(c)), bool)
    lengths = []
    for side in (q, c):
        size = pc.fill_null(pc.list_value_length(side), -1).to_numpy().copy()
        holes = pc.list_parent_indices(side).filter(pc.is_null(pc.list_flatten(side)))
        size[holes.to_numpy()] = -1
        lengths.append(size)
    for size in np.intersect1d(*lengths):
        if size < 0:
            continue
        i, j = (np.flatnonzero(x == size) for x in lengths)
        a, b = (pc.list_flatten(x.take(pa.array(k))).to_numpy().astype(np.float64).reshape(len(k), size) for x, k in ((q, i), (c, j)))
        x = unit(a) @ unit(b).T * 10**DIGITS
        out[np.ix_(i, j)] = np.trunc(x + np.copysign(0.5, x)) / 10**DIGITS + 0.0
        known[np.ix_(i, j)] = True
    return out, known


def score_pairs(named: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, candidate_id, similarity) of the pairs (query_id, candidate_id) that are named."""
    q = queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    c = candidates.select(F.col("id").alias("candidate_id"), F.col("embedding").alias("c"))
    met = named.join(q, "query_id").join(c, "candidate_id")
    return met.select("query_id", "candidate_id", F.round(cosine(F.col("q"), F.col("c")), DIGITS).alias("similarity"))


def vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def blocked(rows: DataFrame, block: str, other: str, blocks: Column | int, others: Column | int) -> DataFrame:
    """``rows`` (id, ...) with their own block, and once for every block of the other side."""
    own = F.pmod(F.xxhash64("id"), blocks if isinstance(blocks, Column) else F.lit(blocks)).cast("int")
    last = (others if isinstance(others, Column) else F.lit(others)).cast("int") - 1
    return rows.withColumn(block, own).withColumn(other, F.explode(F.sequence(F.lit(0), last)))


def _size(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and of coordinates."""
    n, dim = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    return n, max(1, dim or 1)


def grid(queries: DataFrame, candidates: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_bytes: int = BLOCK_BYTES, keys: tuple[str, ...] = (), block_rows: int | None = None) -> DataFrame:
    """What ``kernel`` gives for every pair of blocks of (id, embedding, ...); with ``keys`` only within equal keys.

    A block has at most about ``block_bytes`` of vectors, and ``block_rows`` rows if given."""
    n, dim = _size(queries)
    m, _ = _size(candidates)
    rows = min(max(1, block_bytes // (8 * dim)), block_rows or n + m + 1)
    if keys:
        counts = queries.groupBy(*keys).agg(F.count("*").alias("__n")).join(candidates.groupBy(*keys).agg(F.count("*").alias("__m")), list(keys))
        blocks = counts.select(*keys, F.ceil(F.col("__n") / rows).cast("int").alias("__nq"), F.ceil(F.col("__m") / rows).cast("int").alias("__nc"))
        q = blocked(queries.join(blocks, list(keys)), "qb", "cb", F.col("__nq"), F.col("__nc")).drop("__nq", "__nc")
        c = blocked(candidates.join(blocks, list(keys)), "cb", "qb", F.col("__nc"), F.col("__nq")).drop("__nq", "__nc")
    else:
        # as many tasks as there are cores, if the blocks are not tiny then
        cores = queries.sparkSession.sparkContext.defaultParallelism
        nq, nc = -(-n // rows) or 1, max(-(-m // rows) or 1, min(cores, -(-m // 256) or 1))
        q, c = blocked(queries, "qb", "cb", nq, nc), blocked(candidates, "cb", "qb", nc, nq)
    by = [*keys, "qb", "cb"]
    # columns of their own on either side, which may come from the same table
    q, c = (side.select(*[F.col(x).alias(x) for x in side.columns]) for side in (q, c))
    return q.groupBy(*by).cogroup(c.groupBy(*by)).applyInArrow(kernel, schema)


def _known(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("id", "embedding", *more).where("embedding is not null")


def _similar(q: pa.Table, c: pa.Table, keep_self: bool) -> np.ndarray:
    sim = np.round(unit(vectors(q["embedding"])) @ unit(vectors(c["embedding"])).T, DIGITS) + 0.0
    if not keep_self:
        sim[q["id"].to_numpy()[:, None] == c["id"].to_numpy()[None, :]] = -np.inf
    return sim


def top_k(queries: DataFrame, candidates: DataFrame, k: int, keep_self: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, candidate_id, similarity): the k candidates of largest cosine, of equal ones the smaller id.

    The query itself is no candidate unless ``keep_self``; k beyond the number of candidates gives all of them.
    """
    out = pa.schema([("query_id", pa.int64()), ("candidate_id", pa.int64()), ("similarity", pa.float64())])

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return out.empty_table()
        ids, cid = q["id"].to_numpy(), c["id"].to_numpy()
        order = np.argsort(cid, kind="stable")
        c, cid = c.take(pa.array(order)), cid[order]
        sim = _similar(q, c, keep_self)
        size = min(k, len(cid))
        # what is at least as similar as the k-th, and of those by similarity and id
        least = np.partition(sim, len(cid) - size, axis=1)[:, len(cid) - size]
        row, col = np.nonzero((sim >= least[:, None]) & np.isfinite(sim))
        by = np.lexsort((col, -sim[row, col], row))
        row, col = row[by], col[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < size], col[place < size]
        return pa.Table.from_arrays([pa.array(ids[row]), pa.array(cid[col]), pa.array(sim[row, col])], schema=out)

    found = grid(_known(queries), _known(candidates), best, "query_id long, candidate_id long, similarity double", block_bytes)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "candidate_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "candidate_id", "similarity")


def _own(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """``queries`` (id, embedding, target) with the similarity of the target; null where it is no candidate."""
    target = candidates.select(F.col("id").alias("target"), F.col("embedding").alias("t"))
    return _known(queries, "target").join(target, "target", "left").withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("t")), DIGITS) + F.lit(0.0)).drop("t")


def target_rank(queries: DataFrame, candidates: DataFrame, keep_self: bool = True, by_id: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, target, similarity, rank) for queries (id, embedding, target): 1 + the number of candidates that are
    more similar than the target, or with ``by_id`` as similar and of a smaller id. A target that is no candidate has null
    similarity and rank."""
    out = pa.schema([("query_id", pa.int64()), ("above", pa.int64())])

    def above(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return out.empty_table()
        sim, own = _similar(q, c, keep_self), q["similarity"].to_numpy()[:, None]
        more = sim > own
        if by_id:
            more |= (sim == own) & (c["id"].to_numpy()[None, :] < q["target"].to_numpy()[:, None])
        return pa.Table.from_arrays([q["id"].combine_chunks().cast(pa.int64()), pa.array(more.sum(1))], schema=out)

    scored = _own(queries, candidates)
    counts = grid(scored.where("similarity is not null"), _known(candidates), above, "query_id long, above long", block_bytes)
    ranks = counts.groupBy("query_id").agg((F.sum("above") + 1).alias("rank"))
    return scored.select(F.col("id").alias("query_id"), "target", "similarity").join(ranks, "query_id", "left")


def info_nce(queries: DataFrame, candidates: DataFrame, temperature: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, loss) for queries (id, embedding, target) whose target is a candidate: the log of the summed exponentials
    of all scaled similarities but the query's own, less the target's."""
    out = pa.schema([("query_id", pa.int64()), ("top", pa.float64()), ("total", pa.float64())])

    def sums(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return out.empty_table()
        z = _similar(q, c, False) / temperature
        top = z.max(1)
        total = np.exp(z - np.where(np.isfinite(top), top, 0)[:, None]).sum(1)
        return pa.Table.from_arrays([q["id"].combine_chunks().cast(pa.int64()), pa.array(top), pa.array(total)], schema=out)

    scored = _own(queries, candidates).where("similarity is not null and id <> target")
    parts = grid(scored, _known(candidates), sums, "query_id long, top double, total double", block_bytes).where("total > 0 and top > double('-infinity')")
    most = parts.groupBy("query_id").agg(F.max("top").alias("most"))
    total = parts.join(most, "query_id").groupBy("query_id", "most").agg(F.sum(F.col("total") * F.exp(F.col("top") - F.col("most"))).alias("total"))
    own = scored.select(F.col("id").alias("query_id"), (F.col("similarity") / F.lit(temperature)).alias("own"))
    return total.join(own, "query_id").select("query_id", (F.log("total") + F.col("most") - F.col("own")).alias("loss"))


def max_sim(queries: DataFrame, passages: DataFrame, size: int, digits: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, passage_id, score) of every query with every passage, whose embeddings are flat lists of vectors of
    ``size``: the sum over a query's vectors of the largest inner product with one of the passage's."""
    out = pa.schema([("query_id", pa.int64()), ("passage_id", pa.int64()), ("score", pa.float64())])

    def scores(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return out.empty_table()
        a, b = vectors(q["embedding"]), vectors(c["embedding"])
        a, b = a.reshape(len(a), -1, size), b.reshape(len(b), -1, size)
        got = []
        for x in a:  # a query's vectors with all passages: no more than a block at once
            got.append((b @ x.T).max(1).sum(1))
        ids, pid = q["id"].to_numpy(), c["id"].to_numpy()
        return pa.Table.from_arrays([pa.array(np.repeat(ids, len(pid))), pa.array(np.tile(pid, len(ids))), pa.array(np.round(np.concatenate(got), digits) + 0.0)], schema=out)

    return grid(_known(queries), _known(passages), scores, "query_id long, passage_id long, score double", block_bytes)


def triplet_loss(queries: DataFrame, candidates: DataFrame, group: str, margin: float = 0.2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row: number of pairs and mean loss over every anchor (id, embedding, target, group) and every other candidate
    of its group as the negative. The pairs are summed up in their blocks."""
    out = pa.schema([("pairs", pa.int64()), ("total", pa.float64())])
    eps = 1e-6

    def sums(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return out.empty_table()
        x, y = vectors(q["embedding"]), vectors(c["embedding"])
        near = np.sqrt(((x - vectors(q["positive"]) + eps) ** 2).sum(1))
        cid, pairs_, total = c["id"].to_numpy(), 0, 0.0
        for i, a, d in zip(q["id"].to_numpy(), x, near, strict=True):
            far = np.sqrt(((a - y + eps) ** 2).sum(1))[cid != i]
            pairs_ += len(far)
            total += np.maximum(d - far + margin, 0).sum()
        return pa.Table.from_arrays([pa.array([pairs_], pa.int64()), pa.array([total], pa.float64())], schema=out)

    positive = candidates.select(F.col("id").alias("target"), F.col("embedding").alias("positive"))
    anchors = _known(queries, "target", group).join(positive, "target").drop("target")
    rows = grid(anchors, _known(candidates, group), sums, "pairs long, total double", block_bytes, keys=(group,))
    return rows.agg(F.sum("pairs").alias("pairs"), F.round(F.sum("total") / F.sum("pairs"), 5).alias("loss"))
