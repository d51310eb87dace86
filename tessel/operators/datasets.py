"""Building training sets: joining files and splits, mixing sources, batching, sharding and sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.numbering import numbered
from tessel.plans.lineage import free_name

NO_REFERENCE = "__no_ref__"


def lookup(rows: DataFrame, names: DataFrame, key: str, out: str) -> DataFrame:
    """``rows`` with the path of a name from (name, rel_path); a name without a path stands for itself."""
    found = names.select(F.col("name").alias("__n"), F.col("rel_path").alias("__p"))
    return rows.join(found, rows[key] == F.col("__n"), "left").withColumn(out, F.coalesce("__p", key)).drop("__n", "__p")


def existing(rows: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Rows whose path is in ``listing`` (path)."""
    return rows.join(listing.select(F.col("path").alias(key)), key, "left_semi")


def uncovered(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the ids, which have a column of the same name."""
    return rows.join(ids.select(key), key, "left_anti")


def coverage(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """One row: rows and distinct keys, those not covered, and the covered share of distinct keys."""
    known = ids.select(F.col(key).alias("__k")).distinct().withColumn("__in", F.lit(True))
    per = rows.groupBy(key).agg(F.count("*").alias("n")).join(known, F.col(key) == F.col("__k"), "left")
    missing = F.col("__in").isNull()
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_ids"), F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("missing_rows"), F.count_if(missing).alias("missing_ids"), F.round(1 - F.avg(missing.cast("double")), 6).alias("covered"))


def signature(df: DataFrame, names: list[str] | None = None) -> Column:
    """The sorted names of the columns that are not null in a row."""
    return F.array_sort(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names or df.columns]), lambda x: x.isNotNull()))


def by_reference(rows: DataFrame, ref: str, item: str) -> DataFrame:
    """(reference, items): items of each reference in order; those without one are a group."""
    return rows.groupBy(F.coalesce(F.col(ref).cast("string"), F.lit(NO_REFERENCE)).alias("reference")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def composition(rows: DataFrame, ref: str, augmented: str) -> DataFrame:
    """(composition, n): groups that hold both kinds, only augmented or only original rows."""
    per = rows.groupBy(F.coalesce(F.col(ref).cast("string"), F.lit(NO_REFERENCE)).alias("r")).agg(F.bool_or(F.col(augmented)).alias("a"), F.bool_or(~F.col(augmented)).alias("o"))
    kind = F.when(F.col("a") & F.col("o"), "both").when(F.col("a"), "only_augmented").otherwise("only_original")
    return per.groupBy(kind.alias("composition")).agg(F.count("*").alias("n"))


def appearance_ids(rows: DataFrame, key: str, pos: str, out: str = "id") -> DataFrame:
    """``rows`` with a dense id for each key, from 0, in the order of first appearance.

    The distinct keys are numbered; the rows get their number by a join."""
    k, at = free_name("key", rows), free_name("first", rows)
    first = rows.groupBy(key).agg(F.min(pos).alias(at)).withColumnRenamed(key, k)
    ids = numbered(first, at, out=free_name("number", rows, first)).drop(at)
    number = next(c for c in ids.columns if c != k)
    kept = [c for c in rows.columns if c.lower() != out.lower()]
    return rows.join(ids, rows[key].eqNullSafe(F.col(k))).select(*[rows[c] for c in kept], F.col(number).alias(out))


def interleave_round_robin(sources: dict[str, DataFrame], order: str, stop: str = "first_exhausted") -> DataFrame:
    """Rows of the sources by turns, with source and place. ``first_exhausted`` ends right after the last row of the
    shortest source; ``all_exhausted`` after that of the longest, while exhausted ones begin again."""
    names = list(sources)
    sizes = {s: sources[s].count() for s in names}
    if not all(sizes.values()):
        names = [s for s in names if sizes[s]] if stop == "all_exhausted" else []
    out = None
    if names and stop == "first_exhausted":
        n = min(sizes[s] for s in names)
        end = next(i for i, s in enumerate(names) if sizes[s] == n)
    elif names:
        n = max(sizes[s] for s in names)
        end = max(i for i, s in enumerate(names) if sizes[s] == n)
    for i, s in enumerate(names):
        take = n if i <= end else n - 1  # sources after the one that ends it have had a turn less
        turns = -(-take // sizes[s]) if take else 0
        rows = numbered(sources[s], order, out="__n")
        rows = rows.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(max(turns - 1, 0))))).withColumn("__n", F.col("__n") + F.col("__t") * sizes[s]).where(F.col("__n") < take)
        rows = rows.withColumn("source", F.lit(s)).withColumn("place", F.col("__n") * len(names) + i).drop("__n", "__t")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        out = next(iter(sources.values())).limit(0).withColumn("source", F.lit("")).withColumn("place", F.lit(0).cast("long"))
    return out


def interleave_weighted(sources: dict[str, DataFrame], weights: dict[str, float], order: str, total: int, batch: int = 1, seed: int = 0) -> DataFrame:
    """``total`` rows drawn source by source with the given chances, in batches of one source; a source that ends begins
    again. The source of a batch comes from a hash of its number, so that it is the same on every run and no schedule is
    sent around: batch b takes the source whose span of the unit line holds the hash of (b, seed)."""
    spark = next(iter(sources.values())).sparkSession
    names, whole = sorted(sources), sum(weights.values())
    u = F.conv(F.substring(hash_order(F.col("b"), seed), 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))
    pick, upto = F.lit(names[-1]), 0.0
    edges = []
    for s in names:
        upto += weights[s] / whole
        edges.append((upto, s))
    for edge, s in reversed(edges[:-1]):
        pick = F.when(u < edge, F.lit(s)).otherwise(pick)
    turns = spark.range(total).select(F.col("id").alias("place"), F.floor(F.col("id") / batch).alias("b")).withColumn("source", pick)
    out = None
    for s in names:
        size = max(1, sources[s].count())
        rows = numbered(sources[s], order, out="__n")
        got = numbered(turns.where(F.col("source") == s), "place", out="nth").join(rows, F.pmod("nth", F.lit(size)) == F.col("__n")).drop("__n", "nth", "b")
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    return out


def hash_order(ids: Column, seed: int = 0) -> Column:
    """A shuffled order that is the same on every run, and in any engine that has md5."""
    return F.md5(F.concat_ws(":", ids.cast("string"), F.lit(str(seed))).cast("binary"))


def sample(rows: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement: those of the least hash."""
    return rows.orderBy(hash_order(F.col(id_col), seed), id_col).limit(n)


def shards(rows: DataFrame, order: str, count: int, contiguous: bool = True) -> DataFrame:
    """``rows`` with a shard number: contiguous stretches of ceil(n / count), or by turns."""
    at = free_name("place", rows)
    placed = numbered(rows, order, out=at)
    part = F.floor(F.col(at) / max(1, -(-placed.count() // count))) if contiguous else F.pmod(at, F.lit(count))
    return placed.withColumn("shard", part.cast("int")).drop(at)


def chunked(rows: DataFrame, order: str, size: int) -> DataFrame:
    """``rows`` with the number of their chunk of ``size`` consecutive rows."""
    at = free_name("place", rows)
    return numbered(rows, order, out=at).withColumn("chunk", F.floor(F.col(at) / size)).drop(at)


def pack_groups(groups: DataFrame, size: int, order: str = "group_pos", pad: bool = False, drop_last: bool = False) -> DataFrame:
    """(batch, item, padded) from (group_pos, signature, items): whole groups packed one after the other.

    A group is never split; a batch closes when the next group does not fit or when it is exactly full; a group larger
    than ``size`` is a batch by itself, cut to ``size`` when padded. Padding takes unused items of the same signature,
    then any, then repeats of the batch's own. The packing is a fold over the groups in order, so it runs in one task,
    over groups and not over rows of data: (group, signature, ids) is all it reads.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for pdf in batches for r in pdf.itertuples(index=False)]
        # the first items of each signature and their places: enough for any batch, past its own items and those it took
        heads: dict[str, dict] = {}
        place = 0
        for r in rows if pad else ():
            head = heads.setdefault(r.signature, {})
            for x in r.items if len(head) < 3 * size else ():
                head.setdefault(x, place)
                place += 1
        others: dict[str, list] = {}
        done: list[tuple[list, str]] = []
        now, sig = [], ""
        for r in rows:
            items = list(r.items)
            if now and len(now) + len(items) > size:
                done.append((now, sig))
                now = []
            sig = sig if now else r.signature
            now += items
            if len(now) >= size:
                done.append((now, sig))
                now = []
        if now and not drop_last:
            done.append((now, sig))
        out: list = []
        for b, (own, sig) in enumerate(done):
            own = own[:size] if pad else own
            more: list = []
            if pad and len(own) < size:
                used = set(own)
                pool = [x for x in heads[sig] if x not in used]
                if len(pool) < size - len(own):
                    if sig not in others:
                        others[sig] = [x for _, x in sorted((n, x) for s, h in heads.items() if s != sig for x, n in h.items())]
                    pool = list(dict.fromkeys([*pool, *(x for x in others[sig] if x not in used)]))
                more = (pool + own * (size // max(1, len(own)) + 1))[: size - len(own)]
            out += [(b, x, False) for x in own] + [(b, x, True) for x in more]
            if len(out) >= 1 << 16:
                yield pd.DataFrame(out, columns=["batch", "item", "padded"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["batch", "item", "padded"])

    ordered = groups.select(order, "signature", "items").repartition(1).sortWithinPartitions(order)
    return ordered.mapInPandas(fold, "batch long, item long, padded boolean")


def even_selection(rows: DataFrame, group: str, order: str, count: int) -> DataFrame:
    """``count`` rows of each group at even distance, or all of a smaller one."""
    by = Window.partitionBy(group)
    numbered = rows.withColumn("__p", F.row_number().over(by.orderBy(order)) - 1).withColumn("__n", F.count("*").over(by))
    m = F.least(F.lit(count), F.col("__n"))
    # p is floor(i * (n - 1) / (m - 1)) for some i: the least i that reaches p must give p itself
    i = F.ceil(F.col("__p") * (m - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    hit = F.floor(i * (F.col("__n") - 1) / F.greatest(m - 1, F.lit(1))) == F.col("__p")
    return numbered.where(F.when(m == 1, F.col("__p") == 0).otherwise(hit)).drop("__p", "__n")


def percentile_rank_element(values: Column, n: int, share: float = 0.95) -> Column:
    """The element at the rounded place share * (n - 1), halves to even, of the n sorted whole numbers of a column.

    The aggregate holds a count for each distinct value and not the values: the percentile that falls on the place."""
    return F.round(F.percentile(values, round(share * (n - 1)) / max(1, n - 1))).cast("long")


def best_run(runs: DataFrame, metrics: list[str], step: str) -> DataFrame:
    """The run of largest metrics, one after the other, then of the smaller step; missing values lose."""
    return runs.orderBy(*[F.desc_nulls_last(m) for m in metrics], F.asc(step)).limit(1)


def latest(paths: DataFrame, path: str = "path") -> DataFrame:
    """The path of largest numeric suffix; paths without one are passed over."""
    step = F.regexp_extract(path, r"(\d+)/?$", 1).try_cast("long")
    return paths.withColumn("step", step).where("step is not null").agg(F.max_by(path, "step").alias("path"), F.max("step").alias("step"))


def patch_components_edges(patches: DataFrame, threshold: float) -> DataFrame:
    """(src, dst) of neighbouring patches (t, i, j, id, vector), right or below, nearer than ``threshold``."""
    a = patches.select("t", "i", "j", F.col("id").alias("src"), F.col("vector").alias("a"))
    moved = lambda di, dj: patches.select("t", (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("id").alias("dst"), F.col("vector").alias("b"))
    distance = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x.cast("double")))
    met = a.join(moved(0, 1), ["t", "i", "j"]).unionByName(a.join(moved(1, 0), ["t", "i", "j"]))
    return met.where(distance < threshold).select("src", "dst")


def keep_mask(components: DataFrame, ratio: float, group: str = "component", order: str = "pos") -> DataFrame:
    """Rows with ``keep``: group -1 and single rows stay; of n others max(1, n - round(n * ratio)) at even distance."""
    by = Window.partitionBy(group)
    rows = components.withColumn("__p", F.row_number().over(by.orderBy(order)) - 1).withColumn("__n", F.count("*").over(by))
    m = F.greatest(F.lit(1), F.col("__n") - F.bround(F.col("__n") * F.lit(ratio)).cast("long"))
    i = F.ceil(F.col("__p") * (m - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    hit = F.when(m == 1, F.col("__p") == 0).otherwise(F.floor(i * (F.col("__n") - 1) / F.greatest(m - 1, F.lit(1))) == F.col("__p"))
    return rows.withColumn("keep", (F.col(group) == -1) | (F.col("__n") == 1) | hit).drop("__p", "__n")


def running_mean(rows: DataFrame, value: str, weight: str, order: str, group: str) -> DataFrame:
    """``rows`` with the weighted mean of all values of the group so far."""
    by = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_mean", F.sum(F.col(value) * F.col(weight)).over(by) / F.sum(weight).over(by))


def permutations(count: int, seed: int = 42) -> np.ndarray:
    """(a, b) of hash permutations: a from 1, b from 0, below 2**61 - 1, drawn pair by pair."""
    rng = np.random.RandomState(seed)
    prime = (1 << 61) - 1
    return np.array([(rng.randint(1, prime, dtype=np.uint64), rng.randint(0, prime, dtype=np.uint64)) for _ in range(count)], np.uint64).T
