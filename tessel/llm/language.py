"""Language identification by nearest centroids.

A text is a TF-IDF vector of hashed byte n-grams (1 to 4, over the lower-cased text with runs of other bytes than
letters as one mark), scaled to unit length. The document frequencies come from all texts that may be learned from; for
each language, spherical k-means on a bounded sample gives several centroids. The language of the centroid of largest
cosine is predicted. The score is the softmax of the languages' best cosines. A text nearer to no centroid than all but a
small share of the sample of that language was is marked as not accepted.

Edge cases. A null text, or one without a letter, is `und`, score 0, not accepted. Rows of null language, text or id and
of ids held out are not learned from; rows of one id are learned from once, and equal texts are predicted alike. Ties: of languages with equal cosines the first by name is predicted. Without any row to learn from, as in an
empty table, all is `und`. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm._text import LETTERS, LOWER, chunks
from tessel.plans.lineage import Scratch

BITS = 12
GRAMS = (1, 2, 3, 4)
#: Bound of the sample per language that its centroids are fitted on.
MAX_PER_LANGUAGE = 500
CENTROIDS = 4
#: Share of the sample that the bound of distance leaves out.
REJECTED = 0.002
SHARPNESS = 20.0
UNKNOWN = "und"

_MULT = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """n-gram counts (row x cell) of a chunk of rows."""
    n = len(offs) - 1
    out = np.zeros((n, 1 << BITS), np.float32)
    if not len(buf):
        return out
    letter = LETTERS[buf]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first byte after a letter stays as the mark
    row = np.repeat(np.arange(n), np.diff(offs))[keep]
    sym = np.where(letter, LOWER[buf], 0)[keep].astype(np.uint64)
    size = len(sym)
    h = np.zeros(size, np.uint64)
    for g in GRAMS:
        m = size - g + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + sym[g - 1 :] + np.uint64(1)
        cell = ((h * _MULT[g - 1]) >> np.uint64(64 - BITS)).astype(np.int64)
        ok = row[:m] == row[g - 1 :]
        out += np.bincount(row[:m][ok] << BITS | cell[ok], minlength=n << BITS).reshape(n, -1)
    return out


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.sqrt((a * a).sum(1, keepdims=True)), 1e-12)


def _letters(buf: np.ndarray, offs: np.ndarray, texts: pa.Array, base: int) -> np.ndarray:
    """Whether each row has a letter of any script."""
    ascii_letter = LETTERS & (np.arange(256) < 128)
    seen = np.append(0, np.cumsum(ascii_letter[buf]))
    has = seen[offs[1:]] > seen[offs[:-1]]
    for i in np.flatnonzero(~has & (np.diff(offs) > 0)):
        has[i] = any(c.isalpha() for c in texts[base + int(i)].as_py())
    return has


@dataclass
class Centroids:
    languages: list[str]
    of: np.ndarray
    vectors: np.ndarray
    least: np.ndarray
    idf: np.ndarray


#: Rows of one matrix: 256 rows of 2**12 cells are 4 MB.
_ROWS = 256


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, buf, offs in chunks(column, 1 << 20):
        for a in range(0, hi - lo, _ROWS):
            b = min(a + _ROWS, hi - lo)
            yield lo + a, lo + b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, total = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for lo, hi, buf, offs in _pieces(batch.column(0)):
            df += (counts(buf, offs) > 0).sum(0)
            total += hi - lo
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 1 << BITS)), pa.array(np.append(total, df))], names=["cell", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in _pieces(batch.column(2)):
            x = counts(buf, offs)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, hi - lo) for k in (0, 1)], pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "h", "x"])


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts are taken farthest first from the mean."""
    at = [int((x @ x.mean(0)).argmax())]
    best = x @ x[at[0]]
    for _ in range(1, min(k, len(x))):
        at.append(int(best.argmin()))
        best = np.maximum(best, x @ x[at[-1]])
    c = x[at]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = _unit(np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


def _centroids(idf: np.ndarray, most: int, k: int):
    """A language's sample to its centroids and the least cosine that is accepted."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "x"]).head(most)  # one order whatever order the rows came in
        x = np.stack([np.frombuffer(v, np.float32) for v in pdf["x"]])
        x = x[x.sum(1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "c": [], "least": []})
        x = _unit(x * idf)
        c = _kmeans(x, k)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "c": [c.tobytes()], "least": [float(np.quantile((x @ c.T).max(1), REJECTED))]})

    return of


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None, per_language: int = MAX_PER_LANGUAGE, centroids: int = CENTROIDS) -> Centroids:
    """Centroids from the rows with a language that are not held out.

    A language's sample are the rows whose hash is under a threshold that its number of rows gives, and of these the
    ``per_language`` of least hash: rows are picked where they are, and a language's task gets no more than a few above
    its sample. The driver gets the centroids only.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    if held_out is not None:
        rows = rows.where(~held_out)
    rows = rows.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    table = rows.select("text").mapInArrow(_frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((1 << BITS) + 1)
    df[table["cell"].to_numpy()] = table["n"].to_numpy()  # cell -1, the total, is the last
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)).astype(np.float32) + np.float32(0.1)
    with Scratch() as scratch:
        # six standard deviations more than the sample, so that it is full
        bound = per_language + 6 * math.sqrt(per_language)
        of_lang = rows.groupBy("lang").agg(F.count("*").alias("c")).select(F.col("lang").alias("as"), (F.lit(bound) / F.col("c")).alias("share"))
        of_lang = scratch.cut(of_lang)
        unit = F.pmod("h", F.lit(1 << 40)) / F.lit(float(1 << 40))
        picked = rows.join(of_lang, F.col("lang") == F.col("as")).where(unit < F.col("share")).select("lang", unit.alias("h"), "text")
        # one row for each id, however often it is there
        vectors = picked.mapInArrow(_vectors, "lang string, h double, x binary").groupBy("lang", "h").agg(F.min("x").alias("x"))
        made = vectors.groupBy("lang").applyInPandas(_centroids(idf, per_language, centroids), "lang string, c binary, least double")
        got = sorted(made.collect())  # a row for each language: its few centroids
    names, of, vectors, least = [r.lang for r in got], [], [], []
    for i, r in enumerate(got):
        c = np.frombuffer(r.c, np.float32).reshape(-1, 1 << BITS)
        of += [i] * len(c)
        vectors.append(c)
        least += [r.least] * len(c)
    return Centroids(names, np.array(of, np.int64), np.concatenate(vectors) if vectors else np.zeros((0, 1 << BITS), np.float32), np.array(least), idf)


def _predict(model: Centroids):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*model.languages, UNKNOWN], object)
        head = np.flatnonzero(np.append(True, np.diff(model.of) > 0)) if len(model.of) else None
        for batch in batches:
            texts = batch.column(1)
            for lo, hi, buf, offs in _pieces(texts):
                best, score, ok = np.full(hi - lo, len(model.languages)), np.zeros(hi - lo), np.zeros(hi - lo, bool)
                has = _letters(buf, offs, texts, lo)
                if has.any() and head is not None:
                    sim = _unit(counts(buf, offs) * model.idf) @ model.vectors.T
                    top = np.maximum.reduceat(sim, head, axis=1)
                    which = top.argmax(1)
                    e = np.exp(SHARPNESS * (top - top.max(1, keepdims=True)))
                    best[has] = model.of[head][which[has]]
                    score[has] = (e.max(1) / e.sum(1))[has]
                    ok[has] = (top[np.arange(len(top)), which] >= model.least[head][which])[has]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(langs[best], pa.string()), pa.array(score), pa.array(ok)], names=["id", "lang_pred", "score", "accepted"])

    return of


def predict(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) per document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(model), "id long, lang_pred string, score double, accepted boolean")
