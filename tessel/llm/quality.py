"""Quality rules: fixed limits, then robust outliers by minimum covariance determinant.

Statistics of each whole text are transformed to a vector of five: log of the words, mean word length, and the logs of
the shares of symbols, of words in repeated lines and of words in repeated 8-word windows. For each language and source
the estimate of location and scatter is that of the half of its documents whose covariance has the least determinant.
Five starts are taken: medians and median deviations, spatial signs, squashed coordinates, and two small subsets by hash.
From each start concentration steps run over all documents: squared distances, the half of least distance, its mean and
covariance. Of the halves that the starts end in the one of least determinant is taken. A document whose squared
Mahalanobis distance is beyond the cutoff is rejected.

Distances are counted on a grid of their logs, and every cell carries the sums of which means and covariances are made:
a step is one pass with sums by (group, start, cell), combined before the shuffle, and no group is ever in one task. The
estimates, a row for each group and start, are written tables whose size Spark knows: it broadcasts small ones and
otherwise joins by a shuffle, in which it splits hot groups.

Scatter gets a floor for each coordinate, as most texts have no symbol or repetition at all: what differs by less than
the floor's few multiples is no outlier however equal the others are. The estimate of a group is drawn to that of all
documents, as if ``prior`` documents of the latter were in it; so that nothing switches with the size of a group.

Edge cases. A null or empty text has 0 words and fails the limits. Null languages and sources are values of their own.
Rows that fail the limits are not in the estimates. Repeated rows count as often as they are there, and are judged alike.
Ties: distances in one cell of the grid are in the half together; of starts with equal determinants the first counts. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tessel.llm._text import SPACED, chunks, fold, mix64, powers, words
from tessel.plans.lineage import Scratch

#: The characters that count as symbols, and the limits.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
LEAST_WORDS, MOST_REPEATED = 20, 30

STEPS = 6
#: Rows of all documents' estimate that a group's is mixed with.
PRIOR = 20
#: Rows that a start by hash takes, about.
SUBSET = 18
#: Smallest standard deviation that a coordinate is taken to have.
FLOOR = (0.4, 0.25, 0.35, 0.5, 0.5)
#: Probability of the chi-square distribution at which distances are cut.
CUTOFF = 0.999999
_GRID = 32
_P = len(FLOOR)


def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lang, source, text) to (id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    for batch in batches:
        for lo, hi, buf, offs in chunks(batch.column(3)):
            n = hi - lo
            w = words(buf, offs, SPACED, lower=False)
            zero = np.zeros(n, np.int64)
            out = [np.diff(w.first), zero, zero, zero, zero]
            total = lambda mask: np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[offs])
            if len(buf):
                head = (buf & 0xC0) != 0x80
                out[1] = total(head & SPACED[buf])
                out[2] = total(SYMBOLS[buf])
            if len(w.start):
                out[3] = _repeated_lines(buf, offs, w, n)
                out[4] = _repeated_words(w, n)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, n) for k in range(3)], *[pa.array(x, pa.int64()) for x in out]], names=["id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def _repeated(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an item is equal to an earlier one of its row, and whether to any other one."""
    k = mix64(key + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(k, kind="stable")
    same = k[order][1:] == k[order][:-1]
    later, other = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order[1:]] = same
    other[order[1:]] = same
    other[order[:-1]] |= same
    return later, other


def _repeated_lines(buf, offs, w, n) -> np.ndarray:
    """Lines with a word that are equal, byte for byte, to an earlier line of the text."""
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    newline = buf == 10
    start = np.flatnonzero(edge[:-1] | np.append(False, newline[:-1]))
    stop = np.flatnonzero(newline | edge[1:])
    stop = np.where(newline[stop], stop, stop + 1)
    # a text that ends in \n has an empty last line, which holds no word; starts and stops pair up otherwise
    start = start[: len(stop)]
    row = np.searchsorted(offs, start, "right") - 1
    has = np.searchsorted(w.start, start) < np.searchsorted(w.start, stop)
    start, stop, row = start[has], stop[has], row[has]
    pw, ipw = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(mix64(buf.astype(np.uint64) + np.uint64(1)) * pw[:-1], out=sums[1:])
    key = mix64((sums[stop] - sums[start]) * ipw[start] + (stop - start).astype(np.uint64))
    later, _ = _repeated(key, row)
    return np.bincount(row[later], minlength=n)


def _repeated_words(w, n, size: int = 8) -> np.ndarray:
    """Words in windows of ``size`` words that occur twice or more in the text."""
    s = fold(w.hash, size)
    if not len(s):
        return np.zeros(n, np.int64)
    at = np.flatnonzero(w.row[: len(s)] == w.row[size - 1 :])
    _, other = _repeated(s[at], w.row[at])
    mark = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(mark, at[other], 1)
    np.add.at(mark, at[other] + size, -1)
    return np.bincount(w.row[np.cumsum(mark)[:-1] > 0], minlength=n)


def chi_square(p: float, k: int) -> float:
    """Quantile of the chi-square distribution by the Wilson-Hilferty approximation."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        z = (lo + hi) / 2
        lo, hi = (z, hi) if 0.5 * math.erfc(-z / math.sqrt(2)) < p else (lo, z)
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


def _vector() -> list[Column]:
    words_ = F.col("n_words").cast("double")
    return [F.log1p(words_), F.col("word_chars") / words_, F.log(F.lit(0.02) + F.col("n_symbols") / words_), F.log(F.lit(0.05) + F.col("n_dup_lines") / F.sqrt(words_)), F.log(F.lit(0.05) + F.col("n_repeat_words") / words_)]


_VECTOR = [f"v{i}" for i in range(_P)]
_ALL = "struct<lang: string, source: string, every: boolean>"
_ESTIMATE = f"g {_ALL}, start int, n double, mean array<double>, cov array<double>, inverse array<double>, logdet double"


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Number, sums and sums of products of the vectors of each key."""
    first = [F.sum(v).alias(f"s{i}") for i, v in enumerate(_VECTOR)]
    second = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}{j}") for i in range(_P) for j in range(i, _P)]
    return rows.groupBy(*keys).agg(F.count("*").alias("c"), *first, *second)


_SUMS = [*(f"s{i}" for i in range(_P)), *(f"s{i}{j}" for i in range(_P) for j in range(i, _P))]


def moments(c: float, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from sums and sums of products (upper triangle)."""
    mu = sums[:_P] / c
    cov = np.zeros((_P, _P))
    cov[np.triu_indices(_P)] = sums[_P:] / c
    return mu, cov + np.triu(cov, 1).T - np.outer(mu, mu)


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, start, c, sums) to estimates."""
    floor = np.diag(np.square(FLOOR))
    lists = pa.list_(pa.float64())
    for batch in batches:
        mean, covs, inverse, logdet = [], [], [], []
        for c, *sums in zip(*(batch.column(k).to_pylist() for k in range(2, 3 + len(_SUMS))), strict=True):
            mu, cov = moments(c, np.array(sums))
            mean.append(mu)
            covs.append(cov.ravel())
            inverse.append(np.linalg.inv(cov + floor).ravel())
            logdet.append(float(np.linalg.slogdet(cov + floor)[1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.float64()), *[pa.array(x, lists) for x in (mean, covs, inverse)], pa.array(logdet, pa.float64())], names=["g", "start", "n", "mean", "cov", "inverse", "logdet"])


def _estimates(sums: DataFrame) -> DataFrame:
    return sums.select("g", "start", "c", *_SUMS).mapInArrow(_invert, _ESTIMATE)


def _distance() -> Column:
    d = [F.col(f"v{i}") - F.col("mean")[i] for i in range(_P)]
    return sum((d[i] * d[j] * F.col("inverse")[i * _P + j] for i in range(_P) for j in range(_P)), F.lit(0.0))


def _cell(d: Column) -> Column:
    return F.floor(F.log(F.lit(1e-3) + F.greatest(d, F.lit(0.0))) * _GRID).cast("long")


def _lower(counts: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """The rows of (keys, cell, c, ...) up to the cell in which the share of the key's documents is reached."""
    by = Window.partitionBy(*keys)
    counts = counts.withColumn("upto", F.sum("c").over(by.orderBy("cell"))).withColumn("all", F.sum("c").over(by))
    return counts.where(F.col("upto") - F.col("c") < F.col("all") * share)


def _medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """(g, array of the medians of the values), on a grid of a quarter of the floors."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(v / (FLOOR[i] / 4)).cast("long").alias("cell")) for i, v in enumerate(values)])
    counts = rows.select("g", F.explode(cells).alias("x")).groupBy("g", "x.i", "x.cell").agg(F.count("*").alias("c"))
    at = _lower(counts, ["g", "i"]).groupBy("g", "i").agg(F.max("cell").alias("at"))
    steps = F.array(*[F.lit(f / 4) for f in FLOOR])
    value = (F.col("at") + 0.5) * F.element_at(steps, F.col("i") + 1)
    return at.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("m")))), lambda x: x["m"]).alias("m"))


def _starts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Five first estimates of every group; rows are (g, v0..)."""
    middle = scratch.cut(_medians(rows, [F.col(v) for v in _VECTOR]))
    spread = scratch.cut(_medians(rows.join(middle, "g"), [F.abs(F.col(v) - F.col("m")[i]) for i, v in enumerate(_VECTOR)]).withColumnRenamed("m", "s"))
    size = rows.groupBy("g").agg(F.count("*").alias("rows"))
    scale = F.transform(F.arrays_zip("s", F.array(*[F.lit(f) for f in FLOOR]).alias("f")), lambda x: F.sqrt(F.pow(x["s"] * 1.4826, F.lit(2.0)) + F.pow(x["f"], F.lit(2.0))))
    first = scratch.cut(middle.join(spread, "g").join(size, "g").select("g", "m", scale.alias("s"), "rows"))
    z = [(F.col(v) - F.col("m")[i]) / F.col("s")[i] for i, v in enumerate(_VECTOR)]
    norm = F.sqrt(F.lit(1e-9) + sum((x * x for x in z), F.lit(0.0)))
    vector = lambda start, xs: F.struct(F.lit(start).alias("start"), *[x.alias(v) for v, x in zip(_VECTOR, xs, strict=True)])
    back = lambda xs: [F.col("m")[i] + F.col("s")[i] * x for i, x in enumerate(xs)]
    drawn = lambda seed: F.pmod(F.xxhash64(*_VECTOR, F.lit(seed)), F.lit(1 << 30)) * F.col("rows") < F.lit(float(SUBSET << 30))
    made = [vector(1, back([x / norm * _P**0.5 for x in z])), vector(2, back([F.tanh(x) * 1.5 for x in z]))]
    made += [F.when(drawn(k), vector(k, [F.col(v) for v in _VECTOR])) for k in (3, 4)]
    moved = rows.join(first, "g").select("g", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x")).select("g", "x.*")
    inverse = F.array(*[1 / F.pow(F.col("s")[i], F.lit(2.0)) if i == j else F.lit(0.0) for i in range(_P) for j in range(_P)])
    by_median = first.select("g", F.lit(0).alias("start"), F.col("m").alias("mean"), inverse.alias("inverse"))
    return scratch.cut(by_median.unionByName(_estimates(_sums(moved, "g", "start")).select("g", "start", "mean", "inverse")))


def least_determinant(rows: DataFrame, scratch: Scratch, steps: int = STEPS) -> DataFrame:
    """(g, start, n, mean, cov, inverse, logdet): of each group of ``rows`` (g, v0..) the best estimate of all starts."""
    estimate = _starts(rows, scratch)
    for _ in range(steps):
        cells = _sums(rows.join(estimate.select("g", "start", "mean", "inverse"), "g").select("g", "start", *_VECTOR, _cell(_distance()).alias("cell")), "g", "start", "cell")
        half = _lower(cells, ["g", "start"]).groupBy("g", "start").agg(F.sum("c").alias("c"), *[F.sum(x).alias(x) for x in _SUMS])
        estimate = scratch.cut(_estimates(half))
    best = estimate.groupBy("g").agg(F.min(F.struct("logdet", "start", "n", "mean", "cov", "inverse")).alias("e"))
    return scratch.cut(best.select("g", "e.*"))


def _drawn(prior: float, every: Row):
    """Estimates of groups, drawn to that of all rows."""
    floor = np.diag(np.square(FLOOR))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m0, c0 = np.array(every["mean"]), np.array(every["cov"])
        lists = pa.list_(pa.float64())
        for batch in batches:
            mean, inverse = [], []
            for n, m, c in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                mean.append((n * np.array(m) + prior * m0) / (n + prior))
                inverse.append(np.linalg.inv(((n * np.array(c) + prior * c0) / (n + prior)).reshape(_P, _P) + floor).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mean, lists), pa.array(inverse, lists)], names=["g", "mean", "inverse"])

    return of


def outliers(passed: DataFrame, scratch: Scratch, steps: int = STEPS, prior: float = PRIOR, cutoff: float = CUTOFF) -> DataFrame:
    """``passed`` (lang, source, v0..) with ``distance`` (squared, scaled) and ``outlier``."""
    own = F.struct(F.col("lang").alias("lang"), F.col("source").alias("source"), F.lit(False).alias("every"))
    everything = F.struct(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(True).alias("every"))
    rows = passed.select("*", own.alias("g"))
    twice = scratch.cut(passed.select(F.explode(F.array(own, everything)).alias("g"), *_VECTOR))
    best = least_determinant(twice, scratch, steps)
    every = best.where("g.every").first()
    if every is None:
        return passed.select("*", F.lit(0.0).alias("distance"), F.lit(False).alias("outlier"))
    estimate = scratch.cut(best.select("g", "n", "mean", "cov").mapInArrow(_drawn(prior, every), f"g {_ALL}, mean array<double>, inverse array<double>"))
    # the middle of the distances is brought to the chi-square's, but not below it
    cells = twice.join(estimate, "g").groupBy("g", _cell(_distance()).alias("cell")).agg(F.count("*").alias("c"))
    middle = _lower(cells, ["g"]).groupBy("g").agg(F.max("cell").alias("at"), F.max("all").alias("rows"))
    middle = scratch.cut(middle.select("g", "rows", F.greatest(F.exp((F.col("at") + 1) / _GRID) / chi_square(0.5, _P), F.lit(1.0)).alias("scale")))
    common = middle.where("g.every").first()["scale"]
    scale = (F.col("rows") * F.col("scale") + F.lit(prior * common)) / (F.col("rows") + F.lit(prior))
    final = scratch.cut(estimate.join(middle, "g").select("g", "mean", "inverse", scale.alias("scale")))
    judged = rows.join(final, "g").withColumn("distance", _distance() / F.col("scale"))
    return judged.select(*passed.columns, "distance", (F.col("distance") > chi_square(cutoff, _P)).alias("outlier"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **how) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) per document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    with Scratch() as scratch:
        stats = scratch.cut(rows.mapInArrow(statistics, "id long, lang string, source string, " + ", ".join(f"{c} long" for c in names)))
        failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
        passed = stats.where(~failed).select("*", *[v.alias(f"v{i}") for i, v in enumerate(_vector())])
        kept = outliers(passed, scratch, **how).select("id", *names, F.lit(False).alias("base_failed"), (~F.col("outlier")).alias("kept"), "distance")
        return scratch.keep(kept.unionByName(stats.where(failed).select("id", *names, F.lit(True).alias("base_failed"), F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))))
