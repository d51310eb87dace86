"""Toxicity by multiple-instance learning: sentence scores under a noisy-or, learned from labels of whole documents.

A sentence's logit is a bias plus the weights of its words' features: the hash of the whole word and of its first 4, 5
and 6 bytes, which carry over to words not seen before. A document is toxic if any of its sentences is:
1 - prod(1 - p). Full-batch AdaGrad fits the weights on all labelled documents: only their texts are shuffled, to meet
their labels, their words are written once, as numbers, and in each epoch tasks sum the slopes of their documents. Scoring a document scores its sentences, so the sentences that
offend are known.

Edge cases. Null and empty texts have no sentence and the score 0. Labels without a document, with a null, or of
documents held out are not learned from; of several labels of a document the highest counts; a document that is there
twice is learned from twice. Without labels of both kinds, or with an empty table, every score is below 1e-6. Sums of slopes have
the 24 bits of a float: with other partitions the last digits may differ. Rows are scored one by one, so that equal texts
have equal scores.
Other columns of the input are ignored, or kept as they are by ``score_documents`` and ``reject``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessel.llm._text import LETTERS, chunks, lean, span_hash, words
from tessel.plans.lineage import Scratch

BITS = 18
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
#: Features of fewer documents say nothing: their weight is 0.
LEAST = 3
#: Documents of a block where training has all of them in one process.
BLOCK = 250
#: Bytes of blocks that a task of the fit reads in an epoch: at least, and where there are more than ``_ADDED`` tasks, so
#: that its sums (1 MB) are small beside them.
LEAST_BYTES, TASK_BYTES = 8 << 20, 64 << 20
#: Words of a block where documents come from a table; its last document may go beyond them.
BLOCK_WORDS = 1 << 19
#: Sums of so many tasks are added up at once.
_ADDED = 16
#: Bits of the filter of labelled ids: for each id at least, and at most (2 MB for a million ids, 16 MB from 8 million on).
ID_BITS, MOST_BITS = 16, 1 << 27
#: Bits of a row of the filter, as ``bitmap_construct_agg`` makes it.
_BITMAP = 1 << 15
#: Counts of so many features beside each other are one row of a shuffle, which takes less than a row for each.
_BESIDE = 32
_COUNTS = [f"n{k}" for k in range(_BESIDE)]
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


@dataclass
class MilModel:
    weights: np.ndarray
    bias: float


def features(buf: np.ndarray, offs: np.ndarray):
    """Per word its sentence and (1 + prefixes) buckets, -1 where a word is too short; per sentence row, first and last byte."""
    w = words(buf, offs, LETTERS, keep_prefix=True)
    n = len(w.start)
    if not n:
        return None
    ends = np.cumsum(_END[buf])
    at = ends[w.start]
    new = np.ones(n, bool)
    new[1:] = (np.diff(at) > 0) | (np.diff(w.row) > 0)
    head = np.flatnonzero(new)
    shift = np.uint64(64 - BITS)
    out = np.full((1 + len(PREFIXES), n), -1, np.int32)
    out[0] = w.hash >> shift
    for j, k in enumerate(PREFIXES, 1):
        long = w.end - w.start >= k
        s = w.start[long]
        out[j, long] = (span_hash(w, s, s + k) * np.uint64(2 * k + 1)) >> shift
    last = np.append(head[1:], n) - 1
    return out, head, w.row[head], w.start[head], w.end[last]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in chunks(batch.column(1)):
            if (f := features(buf, offs)) is None:
                continue
            x, head, row, _, _ = f
            size = np.diff(np.append(head, x.shape[1]))
            at = np.searchsorted(row, np.arange(hi - lo + 1))
            edge = np.append(head, x.shape[1])[at]
            some = [i for i in range(hi - lo) if at[i] < at[i + 1]]
            rows = pa.array([lo + i for i in some], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array([x[:, edge[i] : edge[i + 1]].tobytes() for i in some], pa.binary()), pa.array([size[at[i] : at[i + 1]].astype(np.int32).tobytes() for i in some], pa.binary())],
                names=["toxic", "x", "sizes"],
            )


@dataclass
class Block:
    """Documents as training reads them. A word is a column of ``table``, which has the features of each different word."""

    toxic: np.ndarray
    #: The document of each sentence, and how many words it has.
    doc: np.ndarray
    size: np.ndarray
    word: np.ndarray
    #: (1 + prefixes, different words); 2**BITS where a word is too short.
    table: np.ndarray

    def row(self) -> list[bytes]:
        return [a.tobytes() for a in (self.toxic, self.doc, self.size, self.word, self.table)]


_ROW = "toxic binary, doc binary, size binary, word binary, table binary"


def _pack(toxic: np.ndarray, x: list[bytes], size: list[bytes]) -> Block:
    f = np.concatenate([np.frombuffer(a, np.int32).reshape(1 + len(PREFIXES), -1) for a in x], 1)
    f = np.where(f < 0, 1 << BITS, f)
    word = f[0].astype(np.int64)
    for more in f[1:]:
        _, at, word = np.unique(word << (BITS + 1) | more, return_index=True, return_inverse=True)
    sizes = [np.frombuffer(b, np.int32) for b in size]
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), [len(n) for n in sizes])
    few = np.uint16 if len(at) <= 1 << 16 else np.int32
    return Block(np.asarray(toxic, bool), doc, np.concatenate(sizes), word.astype(few), np.ascontiguousarray(f[:, at], np.int32))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a], pa.binary()) for a in _pack(np.array(toxic), x, size).row()], names=["toxic", "doc", "size", "word", "table"])

    toxic, x, size, held = [], [], [], 0
    for batch in _gather(batches):
        toxic += batch.column(0).to_pylist()
        x += batch.column(1).to_pylist()
        size += batch.column(2).to_pylist()
        held += batch.column(1).nbytes
        if held >= BLOCK_WORDS * 4 * (1 + len(PREFIXES)):
            yield packed()
            toxic, x, size, held = [], [], [], 0
    if toxic:
        yield packed()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            toxic, doc, size, word, table = (c[i].as_buffer() for c in batch.columns)
            size, table = np.frombuffer(size, np.int32), np.frombuffer(table, np.int32).reshape(1 + len(PREFIXES), -1)
            few = np.uint16 if table.shape[1] <= 1 << 16 else np.int32
            yield Block(np.frombuffer(toxic, np.bool_), np.frombuffer(doc, np.int32), size, np.frombuffer(word, few), table)


def _once(a: np.ndarray) -> np.ndarray:
    """The different numbers of ``a``, in order."""
    a = np.sort(a)
    return a[np.append(True, np.diff(a) > 0)]


def _frequencies(blocks: Iterator[Block]) -> np.ndarray:
    """How many documents have each feature; after these (one place has those of words too short), at the end, documents, toxic ones, bytes."""
    out = np.zeros((1 << BITS) + _BESIDE, np.int64)
    for b in blocks:
        n = b.table.shape[1]
        pair = _once(np.repeat(b.doc.astype(np.int64), b.size) * n + b.word)
        doc = pair // n
        seen = _once((doc << (BITS + 1) | b.table[:, pair - doc * n]).ravel())
        out[: (1 << BITS) + 1] += np.bincount(seen & (1 << (BITS + 1)) - 1, minlength=(1 << BITS) + 1)
        out[-3:] += len(b.toxic), int(b.toxic.sum()), sum(len(a) for a in b.row())
    return out


def _slopes(blocks: Iterator[Block], w: np.ndarray, bias: float) -> np.ndarray:
    """Sums of the loss's slopes by weight, a place for words too short, and by the bias; w ends with a 0."""
    out = np.zeros((1 << BITS) + 2)
    for b in blocks:
        z = np.clip(bias + np.add.reduceat(w[b.table].sum(0)[b.word], np.cumsum(b.size) - b.size), -35, 35)
        s = np.bincount(b.doc, np.logaddexp(0, z), len(b.toxic))
        slope = np.where(b.toxic, -1 / np.expm1(np.clip(s, 1e-9, 50)), 1.0)
        gz = slope[b.doc] / (1 + np.exp(-z))
        by_word = np.bincount(b.word, np.repeat(gz, b.size), b.table.shape[1])
        for places in b.table:
            np.add.at(out, places, by_word)
        out[-1] += gz.sum()
    return out


def _descend(df: np.ndarray, documents: int, toxic: int, slopes: Callable[[np.ndarray, float], np.ndarray], epochs: int = 80, rate: float = 1.0, sparse: float = 1e-4, prior: float = -11.0) -> MilModel:
    """AdaGrad. ``sparse`` draws weights without effect to 0."""
    d = 1 << BITS
    if not 0 < toxic < documents:
        return MilModel(np.zeros(d, np.float32), -30.0)
    w, g2, bias, b2 = np.zeros(d + 1), np.full(d + 1, 1e-8), prior, 1e-8
    known = np.append(df >= LEAST, False)
    for _ in range(epochs):
        sums = slopes(w, bias) / documents
        g, gb = np.where(known, sums[: d + 1], 0), sums[-1]
        g2 += g * g
        step = rate / np.sqrt(g2)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
        b2 += gb * gb
        bias -= 0.1 * rate * gb / np.sqrt(b2)
    return MilModel(w[:d].astype(np.float32), float(bias))


def fit_arrays(toxic: np.ndarray, x: list[bytes], size: list[bytes], **how) -> MilModel:
    """Weights from the features and sentence sizes of labelled documents that are all in this process."""
    parts = [slice(k, k + BLOCK) for k in range(0, len(toxic), BLOCK)]
    blocks = [_pack(toxic[k], x[k], size[k]) for k in parts]
    n = _frequencies(iter(blocks))
    return _descend(n[: 1 << BITS], int(n[-3]), int(n[-2]), lambda w, bias: _slopes(iter(blocks), w, bias), **how)


def _sums(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([sums.astype(np.float32).tobytes()], pa.binary())], names=["sums"])


def _task(model: Broadcast):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _sums(_slopes(_read(batches), *model.value))

    return of


def _total(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    return sum((np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for batch in batches for x in batch.column(0)), np.zeros((1 << BITS) + 2))


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _sums(_total(batches))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = _frequencies(_read(batches)).reshape(-1, _BESIDE)
    at = np.flatnonzero(n.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(x) for x in n[at].T]], names=["place", *_COUNTS])


def _labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (id, text) without nearly all whose id is not in ``known``: a join would send their texts round, to drop them then.

    A bitmap of the hashes of the known ids goes to all tasks. Ids that meet there by chance stay, so that a join must follow.
    """
    kind = rows.schema["id"].dataType
    if kind != known.schema["id"].dataType or not (isinstance(kind, T.IntegralType) or kind == T.StringType()):
        return rows  # equal ids may have different hashes
    bits = _BITMAP
    most = known.count() * ID_BITS
    while bits < min(most, MOST_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    at = known.select(place.alias("place")).groupBy(F.shiftright("place", 15).alias("bitmap")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(_BITMAP - 1)).alias("bits"))
    placed = rows.withColumn("place", place).withColumn("bitmap", F.shiftright("place", 15))
    byte = F.expr(f"cast(conv(hex(substring(bits, cast(shiftright(place & {_BITMAP - 1}, 3) + 1 as int), 1)), 16, 10) as int)")
    return placed.join(F.broadcast(at), "bitmap").where(F.getbit(byte, F.col("place").bitwiseAND(7).cast("int")) == 1).select("id", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: Column | None = None, **how) -> MilModel:
    """Weights from all labelled documents whose ``id`` is not ``held_out``.

    In each epoch the weights are sent to the tasks. They add their sums up among themselves until ``_ADDED`` rows are left,
    which the driver gets: 16 MB at most.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    if held_out is not None:
        known, rows = known.where(~held_out), rows.where(~held_out)
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    with Scratch() as scratch:
        known = scratch.cut(known)
        made = _labelled(rows, known).join(known, "id").select("toxic", "text").mapInArrow(lean(_blocks), _ROW)
        blocks = scratch.cut(made)
        counted = blocks.mapInArrow(lean(_count), ", ".join(f"{c} long" for c in ("place", *_COUNTS))).groupBy("place").agg(*[F.sum(c).alias(c) for c in _COUNTS]).toArrow()
        n = np.zeros(((1 << BITS) // _BESIDE + 1, _BESIDE), np.int64)  # as many rows at most
        n[counted["place"].to_numpy()] = np.stack([counted[c].to_numpy() for c in _COUNTS], 1)
        n = n.ravel()
        df, documents, toxic, size = n[: 1 << BITS], *n[-3:].tolist()
        tasks = max(1, min(_ADDED, size // LEAST_BYTES), size // TASK_BYTES)
        dealt = blocks.coalesce(tasks)

        def slopes(w: np.ndarray, bias: float) -> np.ndarray:
            model = docs.sparkSession.sparkContext.broadcast((w, bias))
            every, many = dealt.mapInArrow(_task(model), "sums binary"), tasks
            while many > _ADDED:
                many = -(-many // _ADDED)
                every = every.repartition(many).mapInArrow(_add, "sums binary")
            sums = _total(every.toArrow().to_batches())
            model.destroy()
            return sums

        return _descend(df, documents, toxic, slopes, **how)


def _sentences(model: MilModel, column: pa.Array) -> Iterator[tuple]:
    """(first row, end row, bytes, offsets, document scores, and of each sentence its row, first and last byte, logit)."""
    weights = np.append(model.weights, np.float32(0))  # -1 finds the 0
    for lo, hi, buf, offs in chunks(column):
        if (f := features(buf, offs)) is None:
            yield lo, hi, buf, offs, np.zeros(hi - lo), *[np.zeros(0, np.int64)] * 4
            continue
        x, head, row, start, end = f
        z = np.clip(model.bias + np.add.reduceat(weights[x].sum(0), head), -35, 35).astype(np.float64)
        yield lo, hi, buf, offs, -np.expm1(-np.bincount(row, np.logaddexp(0, z), hi - lo)), row, start, end, z


def _scorer(model: MilModel, text: int, schema: pa.Schema, offending: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            score, spans = np.zeros(n), [[] for _ in range(n)]
            for lo, hi, buf, offs, scores, row, start, end, z in _sentences(model, batch.column(text)):
                score[lo:hi] = scores
                p = 1 / (1 + np.exp(-z))
                bad = np.flatnonzero(p >= offending)
                if len(bad):
                    chars = np.cumsum((buf & 0xC0) != 0x80)
                    base = np.append(0, chars)[offs[:-1]]
                    for k in bad:
                        i = row[k]
                        spans[lo + i].append({"start": int(chars[start[k]] - 1 - base[i]), "end": int(chars[end[k] - 1] - base[i]), "score": float(p[k])})
            arrays = [*batch.columns, pa.array(score), pa.array(spans, schema.field(len(schema) - 1).type)]
            yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return of


def _rejecter(model: MilModel, text: int, threshold: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for lo, hi, _, _, scores, *_ in _sentences(model, batch.column(text)):
                score[lo:hi] = scores
            yield batch.filter(pa.array(score < threshold))

    return of


def score_documents(docs: DataFrame, model: MilModel, text_col: str = "text", offending: float = 0.5) -> DataFrame:
    """``docs`` with tox_score and offending: the sentences (start, end in characters, score) that reach ``offending``.

    Columns of ``docs`` that have these names go: they are replaced."""
    kept = docs.select(*[docs[c] for c in docs.columns if c.lower() not in ("tox_score", "offending")])
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    out = T.StructType([*kept.schema.fields, T.StructField("tox_score", T.DoubleType()), T.StructField("offending", T.ArrayType(span))])
    return kept.mapInArrow(lean(_scorer(model, kept.columns.index(text_col), to_arrow_schema(out), offending)), out)


def reject(docs: DataFrame, model: MilModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns as they are."""
    return docs.mapInArrow(lean(_rejecter(model, docs.columns.index(text_col), threshold)), docs.schema)
