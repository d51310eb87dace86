"""Benchmark decontamination by latent semantic retrieval.

1. Counts. The passages of all documents (``window`` words, every ``stride``) give the document frequency of each hashed
   word, and so its idf, which is smoothed and above 0 for every word: an item that lies in many documents makes its own
   words frequent, and must still be found.
2. Basis. For each block of ``block`` items a randomised SVD of the TF-IDF matrix of all passages and of the block's items,
   which together weigh as much: a random projection, one power iteration, an orthonormal basis and the eigenvectors of the
   small projected matrix. Tasks sum their products and add them up among themselves; the driver sends a finished basis
   round. A basis for few items holds most of each, however many items there are.
3. Search. The cosine of every passage with each item's projection, in the space of the words. Beside it every passage that
   shares ``GRAM`` consecutive words with an item (all words of a shorter one) is a candidate, whatever its cosine.
4. Checks. About each candidate, in the passage widened by the item's length on both sides: the words of the item that
   are there must hold ``share`` of its idf mass, and their longest common subsequence must have that share of its words.
   From ``exact_share`` on it is a leak; below, a paraphrase, it is one if the item's answer, its last words, is there too.

The benchmark is the stated query set; it is read in blocks of ``block`` items.

Edge cases. Null and empty texts have no passages; a text shorter than a window is one passage. Items without a word
match nothing; an item whose text is there several times is one item for each id. An empty benchmark or table gives no
leaks. Rows that repeat an id are one document, with one row for each item: that of the largest share, then cosine, then
of the first start. Ties: of passages with equal cosines the first is checked first. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessel.llm._text import ALNUM, chunks, fold, lean, words
from tessel.plans.lineage import Scratch

BITS = 14
RANK, OVERSAMPLE = 128, 8
WINDOW, STRIDE = 48, 24
#: Items that share a basis.
BLOCK = 256
#: Consecutive words that make a passage a candidate.
GRAM = 5
#: A task of the fit has this many passages or more, so that its sums, a matrix, are small beside its texts.
FIT_LEAST = 50_000
#: Sums of so many tasks are added up at once, and bases of so many blocks are used in one pass over the texts.
_ADDED, _AT_ONCE = 32, 4
#: So many of the most frequent buckets are summed by a matrix product with their counts in the pieces.
_OFTEN = 384
#: Passages whose products are made at once.
_PASSAGES = 1024
#: Rows of a matrix that are sent as one part.
_PART = 1024
#: Top bits of a hash that tell the benchmark's words and runs of words from nearly all others.
FILTER_BITS = 22
COSINE = 0.15
#: What a word in every passage weighs.
LEAST_IDF = 0.1
SHARE, EXACT_SHARE, ANSWER_WORDS, ANSWER_SHARE = 0.5, 0.7, 6, 0.5


def passages(first: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end word) of all passages of rows whose words start at first[i] and end at first[i + 1]."""
    n = np.diff(first)
    many = np.where(n > 0, np.maximum(0, -(-(n - window) // stride)) + 1, 0)
    row = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    lo = first[row] + k * stride
    return row, lo, np.minimum(lo + window, first[row + 1])


def smoothed_idf(df: np.ndarray, total: int) -> np.ndarray:
    return (np.log((total + 1) / (df + 1)) + LEAST_IDF).astype(np.float32)


def _buckets(buf, offs):
    w = words(buf, offs, ALNUM)
    return w, (w.hash >> np.uint64(64 - BITS)).astype(np.int64)


def _counts(b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, bucket) in one number, sorted, and how often: of at most 2**18 passages."""
    size = hi - lo
    pair = np.repeat(np.arange(len(lo), dtype=np.uint32) << np.uint32(BITS), size)
    pair |= b[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())].astype(np.uint32)
    pair.sort()
    edge = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    return pair[edge].astype(np.int64), np.diff(np.append(edge, len(pair)))


def _frequencies(window: int, stride: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column(0)):
                w, b = _buckets(buf, offs)
                if not len(b):
                    continue
                row, lo, hi = passages(w.first, window, stride)
                for k in range(0, len(row), _PASSAGES):
                    pair, _ = _counts(b, lo[k : k + _PASSAGES], hi[k : k + _PASSAGES])
                    df += np.bincount(pair & ((1 << BITS) - 1), minlength=1 << BITS)
                total += len(row)
        full = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1)), pa.array(np.append(df[full], total))], names=["bucket", "n"])

    return of


@dataclass
class Latent:
    """idf of each bucket, and the basis: a broadcast matrix (bucket x width), scaled by idf, times a small one (width x rank)."""

    idf: np.ndarray
    wide: Broadcast
    turn: np.ndarray

    @property
    def basis(self) -> np.ndarray:
        """(bucket x rank), scaled by idf; made anew where it is asked for."""
        return self.wide.value @ self.turn


def _tfidf(lists, idf: np.ndarray):
    """Flat buckets, passage of each, and weights of unit rows."""
    size = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate(lists) if len(lists) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    pair, tf = np.unique(row << BITS | flat, return_counts=True)
    row, flat = pair >> BITS, pair & ((1 << BITS) - 1)
    v = tf * idf[flat]
    norm = np.sqrt(np.bincount(row, v * v, len(size)))
    return flat, row, (v / np.maximum(norm, 1e-12)[row]).astype(np.float32)


def _rows_times(flat, row, v, m: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, m.shape[1]), np.float32)
    if len(row):
        head = np.flatnonzero(np.append(True, np.diff(row) > 0))
        out[row[head]] = np.add.reduceat(m[flat] * v[:, None], head)
    return out


def _start(width: int) -> np.ndarray:
    """The random matrix of the projection, from a fixed seed: every task makes its own."""
    return np.random.Generator(np.random.PCG64(7)).standard_normal((1 << BITS, width), np.float32)


def _add_products(lists, idf: np.ndarray, m: np.ndarray, gram: bool, out: np.ndarray) -> None:
    """Adds A'A m, or (A m)'(A m), of the passages ``lists`` to ``out``."""
    flat, row, v = _tfidf(lists, idf)
    y = _rows_times(flat, row, v, m, len(lists))
    if gram:
        out += y.T @ y
    elif len(flat):
        order = np.argsort(flat, kind="stable")
        f = flat[order]
        head = np.flatnonzero(np.append(True, np.diff(f) > 0))
        out[f[head]] += np.add.reduceat(y[row[order]] * v[order][:, None], head)


def _products(idf: np.ndarray, width: int, window: int, stride: int, wides: list[Broadcast]):
    """Sums over all passages of a task, in parts: of A'A times the random matrix, or of the Gram matrix of each of ``wides``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [w.value for w in wides] or [_start(width) * idf[:, None]]
        outs = [np.zeros((width, width)) if wides else np.zeros((1 << BITS, width), np.float32) for _ in tables]
        often, many = _often(idf), _PASSAGES if wides else 8 * _PASSAGES  # rows of the large matrix are added to less often
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column(0)):
                w, b = _buckets(buf, offs)
                if not len(b):
                    continue
                _, lo, hi = passages(w.first, window, stride)
                for k in range(0, len(lo), many):
                    pieces = _pieces(idf, often, b, lo[k : k + many], hi[k : k + many], stride)
                    for table, out in zip(tables, outs, strict=True):
                        y = pieces.sums(table) / pieces.norm[:, None]
                        if wides:
                            out += y.T @ y
                        else:
                            pieces.scatter(y / pieces.norm[:, None], out)
        if not wides:
            outs[0] *= idf[:, None]
        task = TaskContext.get().partitionId() // _ADDED
        for j, out in enumerate(outs):
            for k in range(0, len(out), _PART):
                yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([j]), pa.array([k]), pa.array([out[k : k + _PART].astype(np.float32).tobytes()], pa.binary())], names=["task", "own", "part", "sums"])

    return of


def _often(idf: np.ndarray) -> np.ndarray:
    """For each bucket its place among those of the least idf, or -1."""
    place = np.full(len(idf), -1, np.int16)
    place[np.argsort(idf, kind="stable")[:_OFTEN]] = np.arange(min(_OFTEN, len(idf)))
    return place


def _segment_sums(m: np.ndarray, rows: np.ndarray, head: np.ndarray, n: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """The sum of the rows of ``m`` that rows[head:head + n] names, for each segment; one round for each place in it.

    They are added to ``out`` if it is there."""
    order = np.argsort(-n, kind="stable")
    head = head[order]
    many = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), "left")  # segments that have a place k
    sums = np.zeros((len(n), m.shape[1]), np.float32)
    got = np.empty((256, m.shape[1]), np.float32)  # stays in the cache
    for k, some in enumerate(many):
        at = rows[head[:some] + k]
        for c in range(0, some, 256):
            z = min(c + 256, some)
            np.take(m, at[c:z], 0, got[: z - c], "clip")
            sums[c:z] += got[: z - c]
    if out is None:
        out = np.empty_like(sums)
        out[order] = sums
    else:
        _add_rows(out, order, sums)
    return out


def _add_rows(out: np.ndarray, rows: np.ndarray, more: np.ndarray) -> None:
    for c in range(0, len(rows), 256):
        out[rows[c : c + 256]] += more[c : c + 256]


@dataclass
class _Pieces:
    """Passages as runs of pieces: passages overlap, and every piece of ``stride`` words is summed once.

    first, after: first and end word of each piece; where: the pieces of each passage, ``n`` of them, one after the other;
    counts: of frequent buckets in each piece; flat, at, size: the other buckets, by piece; norm: lengths of the passages in the space of words.
    """

    where: np.ndarray
    n: np.ndarray
    counts: np.ndarray
    often: np.ndarray
    flat: np.ndarray
    at: np.ndarray
    size: np.ndarray
    norm: np.ndarray

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Each passage's sum of its words' rows of ``table``."""
        mine = _segment_sums(table, self.flat, self.at, self.size, self.counts @ table[self.often])
        return _segment_sums(mine, self.where, np.cumsum(self.n) - self.n, self.n)

    def scatter(self, y: np.ndarray, out: np.ndarray) -> None:
        """Adds to the row of each bucket, once for each time that a passage has it, the passage's row of ``y``."""
        order = np.argsort(self.where, kind="stable")
        passage = np.repeat(np.arange(len(self.n)), self.n)[order]
        head = np.searchsorted(self.where[order], np.arange(len(self.size)))
        sums = _segment_sums(y, passage, head, np.diff(np.append(head, len(passage))))
        out[self.often] += self.counts.T @ sums
        if len(self.flat):
            order = np.argsort(self.flat, kind="stable")
            f, piece = self.flat[order], np.repeat(np.arange(len(self.size)), self.size)[order]
            head = np.flatnonzero(np.append(True, np.diff(f) != 0))
            _add_rows(out, f[head], _segment_sums(sums, piece, head, np.diff(np.append(head, len(f)))))


def _pieces(idf: np.ndarray, often: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, stride: int) -> _Pieces:
    n = -(-(hi - lo) // stride)
    piece = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride
    end = np.minimum(piece + stride, np.repeat(hi, n))
    pairs, where = np.unique(piece * (stride + 1) + end - piece, return_inverse=True)
    first, size = pairs // (stride + 1), pairs % (stride + 1)
    flat = b[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
    of = np.repeat(np.arange(len(size)), size)
    place = often[flat]
    known = place >= 0
    k = int(often.max()) + 1
    counts = np.bincount(of[known] * k + place[known], minlength=len(size) * k).astype(np.float32).reshape(-1, k)
    rest = np.bincount(of[~known], minlength=len(size))
    pair, tf = _counts(b, lo, hi)
    norm = np.sqrt(np.bincount(pair >> BITS, (tf * idf[pair & (1 << BITS) - 1]) ** 2, len(lo)))
    by_place = np.empty(k, np.int64)
    by_place[often[often >= 0]] = np.flatnonzero(often >= 0)
    return _Pieces(where, n, counts, by_place, flat[~known].astype(np.uint16), np.cumsum(rest) - rest, rest, np.maximum(norm, 1e-9).astype(np.float32))


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sum of a part's matrices, one from each task or group of tasks."""
    total = sum((np.frombuffer(x, np.float32).astype(np.float64) for x in sorted(pdf["sums"])), np.zeros(1))
    return pdf.iloc[:1].assign(sums=[total.astype(np.float32).tobytes()])


def _added(texts: DataFrame, idf: np.ndarray, width: int, window: int, stride: int, wides: list[Broadcast]) -> DataFrame:
    schema = "task long, own long, part long, sums binary"
    every = texts.mapInArrow(lean(_products(idf, width, window, stride, wides)), schema)
    some = every.groupBy("task", "own", "part").applyInPandas(_add, schema)
    return some.groupBy("own", "part").applyInPandas(_add, schema).select("own", "part", "sums")


def _orthonormal(items: list[np.ndarray], idf: np.ndarray, width: int, weight: float):
    """Parts of A'A times the random matrix to parts of an orthonormal basis, with a block's items added."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = _start(width)
        out = np.zeros_like(start)
        _add_products(items, idf, start, False, out)
        out *= np.float32(weight)
        for batch in batches:
            for k, x in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                out[k : k + _PART] += np.frombuffer(x, np.float32).reshape(-1, width)
        q = np.linalg.qr(out)[0].astype(np.float32)
        for k in range(0, len(q), _PART):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([q[k : k + _PART].tobytes()], pa.binary())], names=["part", "sums"])

    return of


def _matrix(parts: Iterable[Row], width: int) -> np.ndarray:
    got = {r.part: np.frombuffer(r.sums, np.float32) for r in parts}
    return np.concatenate([got[k] for k in sorted(got)]).reshape(-1, width)


def fit_latent(docs: DataFrame, blocks: list[list[np.ndarray]], scratch: Scratch, text_col: str = "text", rank: int = RANK, window: int = WINDOW, stride: int = STRIDE) -> list[Latent]:
    """idf over all passages of ``docs``, and the latent basis of each block of items with all passages.

    Tasks add up their products among themselves; the driver gets the finished basis of a block, once, to broadcast it.
    """
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    counts = texts.mapInArrow(lean(_frequencies(window, stride)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = counts["bucket"].to_numpy(), counts["n"].to_numpy()  # at most 2**BITS + 1 rows
    total = int(n[bucket < 0].sum())
    df = np.zeros(1 << BITS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    idf = smoothed_idf(df, total)
    dealt = texts.coalesce(max(1, total // FIT_LEAST))
    width = rank + OVERSAMPLE
    first = scratch.cut(_added(dealt, idf, width, window, stride, []).drop("own"))  # the same for all blocks
    made = []
    for k in range(0, len(blocks), _AT_ONCE):
        some = blocks[k : k + _AT_ONCE]
        wides, owns = [], []
        for items in some:
            weight = max(1.0, total / len(items))
            ready = first.repartition(1).mapInArrow(lean(_orthonormal(items, idf, width, weight)), "part long, sums binary")
            m = _matrix(ready.toLocalIterator(), width) if total else _alone(items, idf, width)
            own = np.zeros((width, width), np.float32)
            _add_products(items, idf, m, True, own)
            owns.append(own * np.float32(weight))
            wides.append(docs.sparkSession.sparkContext.broadcast(m * idf[:, None]))
        if total:
            sums = _added(dealt, idf, width, window, stride, wides).collect()  # a matrix of width x width for each block
            for j in range(len(some)):
                owns[j] = owns[j] + _matrix([r for r in sums if r.own == j], width)
        for own, wide in zip(owns, wides, strict=True):
            _, vectors = np.linalg.eigh(own.astype(np.float64))
            made.append(Latent(idf, wide, vectors[:, ::-1][:, :rank].astype(np.float32)))
    return made


def _alone(items: list[np.ndarray], idf: np.ndarray, width: int) -> np.ndarray:
    """The basis of items without any passage."""
    (batch,) = [pa.Table.from_batches(_orthonormal(items, idf, width, 1.0)(iter(())))]
    return np.concatenate([np.frombuffer(x, np.float32) for x in batch["sums"].to_pylist()]).reshape(-1, width)


def lcs(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of the item."""
    masks: dict = {}
    for i, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for x in text.tolist():
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Runs:
    """Which runs of consecutive words are an item's: GRAM words, or all words of a shorter item."""

    def __init__(self, hashes: list[np.ndarray]):
        sizes = np.array([min(GRAM, len(h)) for h in hashes])
        self.by_size = []
        for k in np.unique(sizes):
            of = [(fold(hashes[j], int(k)), j) for j in np.flatnonzero(sizes == k)]
            run, item = np.concatenate([g for g, _ in of]), np.repeat([j for _, j in of], [len(g) for g, _ in of])
            order = np.argsort(run, kind="stable")
            self.by_size.append((int(k), run[order], item[order]))

    def tables(self) -> list[np.ndarray]:
        made = []
        for _, run, _ in self.by_size:
            ours = np.zeros(1 << FILTER_BITS, bool)
            ours[(run >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            made.append(ours)
        return made

    def find(self, h: np.ndarray, row: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item) of every run of an item's in rows of words."""
        places, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for (k, run, item), ours in zip(self.by_size, tables, strict=True):
            g = fold(h, k)
            at = np.flatnonzero(ours[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] & (row[: len(g)] == row[k - 1 : k - 1 + len(g)]))
            lo, hi = np.searchsorted(run, g[at], "left"), np.searchsorted(run, g[at], "right")
            n = hi - lo
            places.append(np.repeat(at, n))
            items.append(item[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.concatenate(places), np.concatenate(items)


def _search(latent: Latent, ids: np.ndarray, items: list[np.ndarray], hashes: list[np.ndarray], window: int, stride: int, cosine: float, share: float, exact_share: float):
    unit = lambda a: a / np.maximum(np.sqrt((a * a).sum(1, keepdims=True)), 1e-12)
    size = np.array([len(x) for x in items], np.int64)
    at = np.append(0, np.cumsum(size))
    idf = latent.idf.astype(np.float64)
    runs = Runs(hashes)
    mine, own = np.unique(np.concatenate(hashes), return_inverse=True) if len(hashes) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    weight = idf[np.concatenate(items)] if len(items) else np.zeros(0)
    mass = np.add.reduceat(weight, at[:-1]) if len(items) else np.zeros(0)
    schema = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = np.zeros(1 << FILTER_BITS, bool)
        ours[(mine >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        tables = runs.tables()
        basis = latent.basis if len(items) else None
        often = _often(latent.idf)
        q = unit(np.add.reduceat(basis[np.concatenate(items)], at[:-1])) if len(items) else None
        for batch in batches:
            best: dict = {}
            for base, _, buf, offs in chunks(batch.column(1)):
                w, b = _buckets(buf, offs)
                if not len(b) or not len(items):
                    continue
                row, lo, hi = passages(w.first, window, stride)
                first_of_row = np.searchsorted(row, np.arange(len(w.first)))
                # places of the benchmark's words, by word and then by place
                place = np.flatnonzero(ours[(w.hash >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                word = np.minimum(np.searchsorted(mine, w.hash[place]), len(mine) - 1)
                known = mine[word] == w.hash[place]
                n_words = len(b) + 1
                places = np.sort(word[known] * n_words + place[known])
                # passages that share a run of words with an item
                start, j = runs.find(w.hash, w.row, tables)
                r = w.row[start]
                p = first_of_row[r] + np.minimum((start - w.first[r]) // stride, first_of_row[r + 1] - first_of_row[r] - 1)
                shared = np.unique(p * len(items) + j)
                found = []
                for k in range(0, len(row), 1024):
                    p = np.arange(k, min(k + 1024, len(row)))
                    pieces = _pieces(idf, often, b, lo[p], hi[p], stride)
                    sim = pieces.sums(basis) @ q.T / pieces.norm[:, None]
                    near = sim >= cosine
                    i = slice(*np.searchsorted(shared, (k * len(items), (k + 1024) * len(items))))
                    near.ravel()[shared[i] - k * len(items)] = True
                    i, j = np.nonzero(near)
                    i, j, s = p[i], j, sim[i, j]
                    # the check of the mass, for the stretch that it reads: the passage widened by the item's length
                    a, z = np.maximum(lo[i] - size[j], w.first[row[i]]), np.minimum(hi[i] + size[j], w.first[row[i] + 1])
                    for c in range(0, len(i), 4096):
                        c = slice(c, c + 4096)
                        n = size[j[c]]
                        head = np.cumsum(n) - n
                        x = np.repeat(at[j[c]] - head, n) + np.arange(n.sum())
                        begin = own[x] * n_words + np.repeat(a[c], n)
                        after = np.append(places, np.iinfo(np.int64).max)[np.searchsorted(places, begin)]
                        here = after < own[x] * n_words + np.repeat(z[c], n)
                        got = np.add.reduceat(weight[x] * here, head)
                        some = np.add.reduceat(here.astype(np.int64), head)
                        ok = np.flatnonzero((got >= share * mass[j[c]]) & (some >= share * n))
                        found += zip(i[c][ok].tolist(), j[c][ok].tolist(), s[c][ok].tolist(), a[c][ok].tolist(), z[c][ok].tolist(), strict=True)
                # one leak for each document and item, at the passage most alike first
                for i, j, s, a, z in sorted(found, key=lambda x: -x[2]):
                    key = (base + int(row[i]), j)
                    have = best.get(key)
                    if have is not None and have[2] >= exact_share:
                        continue
                    text = w.hash[a:z]
                    got = lcs(hashes[j], text) / size[j]
                    if got >= share and (have is None or got > have[2]):
                        tail = hashes[j][-ANSWER_WORDS:]
                        best[key] = i - first_of_row[row[i]], s, got, lcs(tail, text) / len(tail)
            out = [(r, j, *x) for (r, j), x in sorted(best.items()) if x[2] >= exact_share or x[3] >= ANSWER_SHARE]
            rows = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([int(ids[x[1]]) for x in out], pa.int64()), pa.array([int(x[2]) * stride for x in out], pa.int32()), *[pa.array([float(x[k]) for x in out], pa.float64()) for k in (3, 4, 5)]], schema=schema)

    return of


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cosine: float = COSINE, share: float = SHARE, exact_share: float = EXACT_SHARE, window: int = WINDOW, stride: int = STRIDE, block: int = BLOCK) -> DataFrame:
    """(id, item_id, start, cosine, lcs, answer) for each document and benchmark item that is found in it.

    start: first word of the passage most alike; lcs, answer: shares of the item's words and of its last ones.
    """
    rows = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null").distinct().orderBy("id", "text").toArrow()
    ids, items, hashes = [], [], []
    if len(rows):
        for lo, hi, buf, offs in chunks(rows["text"].combine_chunks()):
            w, b = _buckets(buf, offs)
            for i in range(hi - lo):
                if w.first[i] < w.first[i + 1]:
                    ids.append(rows["id"][lo + i].as_py())
                    items.append(b[w.first[i] : w.first[i + 1]])
                    hashes.append(w.hash[w.first[i] : w.first[i + 1]])
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item_id long, start int, cosine double, lcs double, answer double"
    if not items:
        return texts.where("false").mapInArrow(lean(_search(Latent(np.zeros(1), None, None), np.zeros(0), [], [], window, stride, cosine, share, exact_share)), schema)
    parts = [slice(k, k + block) for k in range(0, len(items), block)]
    with Scratch() as scratch:
        latents = fit_latent(texts, [items[part] for part in parts], scratch, window=window, stride=stride)
        out = None
        for part, latent in zip(parts, latents, strict=True):
            found = texts.where("text is not null").mapInArrow(lean(_search(latent, np.array(ids[part]), items[part], hashes[part], window, stride, cosine, share, exact_share)), schema)
            out = found if out is None else out.unionByName(found)
        # rows that repeat an id: their best; the leaks are few beside the documents
        best = out.groupBy("id", "item_id").agg(F.max(F.struct("lcs", "cosine", (-F.col("start")).alias("start"), "answer")).alias("b"))
        leaks = scratch.keep(best.select("id", "item_id", (-F.col("b.start")).alias("start"), "b.cosine", "b.lcs", "b.answer"))
        for latent in latents:
            latent.wide.destroy()
    return leaks
