"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signatures. A shingle's hash goes through one permutation, sigma, once. Coordinate k of the signature is the least value
of a second permutation, pi, over the shingles moved k places round the circle of 2**32: two permutations give all
coordinates. Bands of a few coordinates make the buckets in which candidates meet.

No pair list. Documents of equal sets are one class from the start, found by a 128-bit sum of the set. In each bucket two
members are pivots, the one that meets the most others over all bands and one by chance, and only (pivot, member) pairs
are verified, on the full sets. What is verified is merged to components.

The rest, exactly. Members of buckets that then hold more than one component are compared across components by prefixes:
with the shingles of a set in one order for all, those of one component only and then the rarest first, by exact counts,
two sets that reach the threshold share one among the first n - ceil(0.75 n) + 1 of either. Copies that differ too much
to be linked have as many shingles of their own, and so meet nobody there. Those that share a prefix shingle are a group,
dealt to blocks of bounded size, and each pair of blocks is compared in one task by counting shared shingles in an index;
only links go out. Blocks of one and the same component are not compared. So no pair that shares a bucket stays
undecided, unless it is in one component already.

With 32 bands of 4 coordinates a pair at the threshold of 0.75 meets in no bucket with a probability of 5e-6.

Edge cases. Null, empty and all-space texts have empty sets: linked with nothing, their own component, kept. A row
without an id takes no part: its component is null and it is kept. Rows that repeat an id are one document, linked if
any of its texts is. An empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._text import Words, chunks, fold, lean, mix64, words
from tessel.operators.graph import connected_components
from tessel.plans.lineage import Scratch

BANDS, ROWS = 32, 4
#: The chance pivot of a bucket is its member of the least id under this constant.
PIVOT = 0x2545F4914F6CDD1D
#: Documents, and shingles, that a block holds on average at most when groups are compared exactly.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 20
#: Members of one pivot that are verified by one task's stretch of rows.
BLOCK = 256


def shingle_sets(w: Words, rows: int, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row of fewer words has one for its whole sequence."""
    s = fold(w.hash, size)
    sets = []
    for i in range(rows):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        if hi - lo >= size:
            sets.append(np.unique(s[lo : hi - size + 1]))
        elif hi > lo:
            sets.append(mix64(fold(w.hash[lo:hi], hi - lo) + np.uint64(hi - lo)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets, a row each."""
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    sigma = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        y = sigma + np.uint32(k)  # the shift round the circle
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(13)
        y *= np.uint32(0xC2B2AE35)
        y ^= y >> np.uint32(16)
        out[:, k] = np.minimum.reduceat(y, begin)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket key for each band."""
    parts = sig.astype(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        key = mix64(key * np.uint64(0x9DDFEA08EB382D69) + parts[:, :, j])
    return key.astype(np.int64)


_BASE = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("fp_a", pa.int64()), ("fp_b", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _describe(bands: int, rows: int, size: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in chunks(batch.column(1)):
                sets = shingle_sets(words(buf, offs), hi - lo, size)
                full = [i for i, s in enumerate(sets) if len(s)]
                fp = np.zeros((hi - lo, 2), np.int64)
                keys: list = [None] * (hi - lo)
                if full:
                    some = [sets[i] for i in full]
                    for i, s, k in zip(full, some, band_keys(signatures(some, bands * rows), bands, rows), strict=True):
                        fp[i] = s.sum(dtype=np.uint64).astype(np.int64), mix64(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64).astype(np.int64)
                        keys[i] = k
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array(keys, pa.list_(pa.int64()))], schema=_BASE)

    return of


def _confirm(percent: int, size: int):
    """Rows (a, b, text) of one stretch come with a's own text first; the pairs that reach the threshold go out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, held = None, []
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ok: list[tuple[int, int]] = []
            for lo, hi, buf, offs in chunks(batch.column(2)):
                for i, s in enumerate(shingle_sets(words(buf, offs), hi - lo, size), lo):
                    if a[i] != pivot:
                        pivot, held = a[i], []
                    if b[i] == a[i]:
                        held.append(s)
                        continue
                    for p in held:
                        small, great = (p, s) if len(p) < len(s) else (s, p)
                        if 100 * len(small) < percent * len(great) or not len(small):
                            continue
                        at = np.searchsorted(great, small)
                        at[at == len(great)] = 0
                        both = int((great[at] == small).sum())
                        if 100 * both >= percent * (len(small) + len(great) - both):
                            ok.append((a[i], b[i]))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ok], pa.int64()), pa.array([x for _, x in ok], pa.int64())], names=["a", "b"])

    return of


def verify_pairs(pairs: DataFrame, texts: DataFrame, scratch: Scratch, percent: int = 75, size: int = 5) -> DataFrame:
    """Those (a, b) of ``pairs`` whose full shingle sets reach the threshold. ``texts``: (id, text).

    Each text moves once, to its pivots: a pivot with many members is dealt to several stretches, with a copy of its own
    text in front of each.
    """
    blocks = scratch.cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    members = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    pivots = blocks.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    wanted = members.unionByName(pivots)
    rows = wanted.join(texts, wanted["b"] == texts["id"]).select("a", "b", "block", "text")
    dealt = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("a") != F.col("b"))
    return dealt.select("a", "b", "text").mapInArrow(lean(_confirm(percent, size)), "a long, b long").distinct()


def _sets(size: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in chunks(batch.column(2)):
                sets = shingle_sets(words(buf, offs), hi - lo, size)
                keys = pa.LargeListArray.from_arrays(np.cumsum([0, *map(len, sets)]), np.concatenate(sets).astype(np.int64)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, hi - lo) for k in (0, 1)], pa.array([len(s) for s in sets], pa.int64()), keys], names=["rep", "label", "n", "keys"])

    return of


def _across(rows: DataFrame) -> DataFrame:
    """(key, df, hub) of the keys of ``rows`` (rep, label, key) that occur under more than one label."""
    found = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("rep").alias("hub"), F.count("*").alias("df"))
    return found.where("lo <> hi").select("key", "df", "hub")


def _met(sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(rep, label, n, hub): the documents of ``sets`` (rep, label, n, keys) that share prefix shingles across labels, with
    the least of those that share one: two documents that share one have a hub in common.

    In the common order of shingles those of one label only come first and then the others, the rarest first. A
    document has a shared one in its prefix only if nearly ``percent`` of its shingles are shared.
    """
    every = sets.select("rep", "label", "n", F.explode("keys").alias("key"))
    common = scratch.cut(_across(every).select("key", "df"))
    shared = every.join(common, "key").groupBy("rep", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("shared"))
    least = F.ceil(F.col("n") * F.lit(percent) / 100).cast("int")
    heads = shared.where(F.size("shared") >= least).select("rep", "label", "n", F.explode(F.slice("shared", F.lit(1), F.size("shared") - least + 1)).alias("s"))
    heads = scratch.cut(heads.select("rep", "label", "n", F.col("s.key").alias("key")))
    hubs = scratch.cut(_across(heads).select("key", "hub"))
    return scratch.cut(heads.join(hubs, "key").select("rep", "label", "n", "hub").distinct())


def _compare(percent: int):
    """Rows (pair of blocks, same, side, id, label, keys), a pair's rows in one stretch: one link for each document and label."""

    def links(docs: list, own: bool) -> list[tuple[int, int]]:
        probe, index = ([x for x in docs if x[0] == side] for side in ((0, 0) if own else (0, 1)))
        if not probe or not index:
            return []
        sizes = np.array([len(x[3]) for x in index])
        label = np.array([x[2] for x in index])
        ids = np.array([x[1] for x in index])
        flat = np.concatenate([x[3] for x in index])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(index)), sizes)[order]
        out = []
        for _, i, lab, s in probe:
            lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, "right")
            n = hi - lo
            if not n.any():
                continue
            both = np.bincount(owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(index))
            ok = np.flatnonzero((100 * both >= percent * (len(s) + sizes - both)) & (label != lab))
            out += [(int(i), int(ids[k])) for k in ok[np.unique(label[ok], return_index=True)[1]]]
        return out

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])
        now, docs, own = None, [], False
        for batch in batches:
            pair, same, side, rep, label = (batch.column(k).to_pylist() for k in range(5))
            for i in range(batch.num_rows):
                if pair[i] != now:
                    yield pack(links(docs, own))
                    now, docs, own = pair[i], [], same[i]
                # a copy: what is held must not hold the batch
                docs.append((side[i], rep[i], label[i], np.sort(batch.column(5)[i].values.to_numpy().view(np.uint64))))
        yield pack(links(docs, own))

    return of


def _links_across(met: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (a, b) across labels among the documents of ``met`` that have a hub in common."""
    docs = met.withColumnRenamed("hub", "g")
    # a label with half a block or more has blocks of its own, which are not compared with each other
    of_label = docs.groupBy("g", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    own = F.when(F.col("c") >= BLOCK_DOCS // 2, F.col("label"))
    of_label = scratch.cut(of_label.select("g", "label", "c", "s", own.alias("own")))
    many = F.greatest(F.ceil(F.sum("c") / BLOCK_DOCS), F.ceil(F.sum("s") / BLOCK_SHINGLES)).cast("int")
    of_block = scratch.cut(of_label.groupBy("g", "own").agg(many.alias("many")))
    placed = docs.join(of_label.select("g", "label", "own"), ["g", "label"])
    placed = placed.join(of_block.select(F.col("g").alias("g2"), F.col("own").alias("own2"), "many"), (F.col("g") == F.col("g2")) & F.col("own").eqNullSafe(F.col("own2")))
    placed = placed.select("g", "rep", "label", F.xxhash64("g", "own", F.pmod(F.xxhash64("rep"), F.col("many"))).alias("block"))
    blocks = of_block.select("g", "own", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("k")).select("g", "own", F.xxhash64("g", "own", F.col("k").cast("long")).alias("block"))
    other = blocks.select("g", F.col("own").alias("own2"), F.col("block").alias("block2"))
    pairs = blocks.join(other, "g").where("block <= block2 and (own is null or own2 is null or own <> own2)").select("g", F.xxhash64("block", "block2").alias("pair"), "block", "block2", (F.col("block") == F.col("block2")).alias("same"))
    sides = pairs.select("g", "pair", "same", F.lit(0).alias("side"), "block").unionByName(pairs.where("not same").select("g", "pair", "same", F.lit(1).alias("side"), F.col("block2").alias("block")))
    dealt = placed.join(sides, ["g", "block"]).select("pair", "same", "side", F.col("rep").alias("r"))
    rows = dealt.join(sets, dealt["r"] == sets["rep"]).select("pair", "same", "side", "rep", "label", "keys")
    return rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(lean(_compare(percent)), "a long, b long").distinct()


def _joined(labels: DataFrame, fresh: DataFrame, cut) -> DataFrame:
    """The components (node, component) of before when the links ``fresh`` (a, b) are added: whole components are joined."""
    named = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    ends = fresh.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = cut(connected_components(ends, "a", "b"))
    again = labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    # nodes that were alone before
    alone = merged.join(labels.select("node"), "node", "left_anti")
    return again.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, size: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with Scratch() as scratch:
        cut = scratch.cut
        base = cut(texts.mapInArrow(lean(_describe(bands, rows, size)), "id long, n long, fp_a long, fp_b long, bands array<long>"))
        # small tables are written before they are joined: Spark broadcasts them, or splits the hot keys of the other side
        reps = cut(base.where("n > 0 and id is not null").groupBy("fp_a", "fp_b", "n").agg(F.min("id").alias("rep"), F.count("*").alias("m")).where("m > 1").drop("m"))
        rep = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("rep", "id"))
        member = cut(base.join(reps, ["fp_a", "fp_b", "n"], "left").withColumn("rep", rep).select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")))
        every = member.where("bands is not null").select("rep", "n", F.explode("bands").alias("key"))
        shared = cut(every.groupBy("key").agg(F.count("*").alias("m"), F.min(F.col("rep").bitwiseXOR(F.lit(PIVOT))).alias("chance")).where("m > 1"))
        buckets = cut(every.join(shared, "key").select("key", "rep", "n", "m", F.col("chance").bitwiseXOR(F.lit(PIVOT)).alias("chance")))
        met = buckets.groupBy("rep").agg(F.sum("m").alias("meets"))
        hubs = cut(buckets.join(met, "rep").groupBy("key").agg(F.max(F.struct("meets", F.col("rep"))).alias("hub")))
        candidates = cut(texts.join(met, texts["id"] == met["rep"], "left_semi"))

        sizes = buckets.select("rep", "n").distinct()
        stars = buckets.join(hubs, "key").select("rep", "n", F.explode(F.array("chance", "hub.rep")).alias("pivot")).where("rep <> pivot").distinct()
        close = stars.join(sizes.select(F.col("rep").alias("pivot"), F.col("n").alias("n_p")), "pivot").where(f"100 * least(n, n_p) >= {percent} * greatest(n, n_p)")
        pairs = cut(close.select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
        # same id, different texts: one node, whose classes are joined
        twin = member.where("rep is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
        found = cut(verify_pairs(pairs, candidates, scratch, percent, size).unionByName(twin))
        labels = cut(connected_components(found, "a", "b"))

        named = buckets.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("label"))
        mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        live = cut(named.join(mixed, "key", "left_semi").select("rep", "label").distinct())
        if not live.isEmpty():
            held = candidates.join(live, candidates["id"] == live["rep"]).select("rep", "label", "text")
            sets = cut(held.mapInArrow(lean(_sets(size)), "rep long, label long, n long, keys array<long>"))
            fresh = cut(_links_across(_met(sets, scratch, percent), sets, scratch, percent))
            if not fresh.isEmpty():
                labels = _joined(labels, fresh, cut)
        joined = member.join(labels, member["rep"] == labels["node"], "left")
        component = F.coalesce("component", "rep", "id")
        return scratch.keep(joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, w.doc_id) AS component_id, w.doc_id = coalesce(c.component, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id
"""
