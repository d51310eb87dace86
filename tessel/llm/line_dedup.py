"""Repeated runs of lines by winnowing over line hashes.

A document is its sequence of lines that hold a word; a line's hash is that of its words in lower case. A window is a
shortest stretch of lines with at least ``min_words`` words, seen from its first or from its last line. Each window's
line of least hash is a fingerprint, so that two equal runs of that many words share one without fail. Fingerprints that
occur more than once are joined back to their positions, where the match is extended both ways: every window about the
position is compared as a whole, and the windows that are found again make up the repeated runs. Of equal windows the
first in the order of (id, hash of the text, line) stays; the lines of every later one are deleted.

So a line goes if and only if it lies in a run of at least ``min_words`` words, over whole lines, that occurs before.

Edge cases. Null stays null and an empty text empty. A row without an id is left as it is. Rows of equal id and text are
one document. A document of which all goes keeps its row, with an empty text. An empty table gives an empty one. Other
columns pass through, whatever their names; ``text_col`` is replaced, and n_lines, n_deleted are added, in place of
columns of these names, unless ``line_dedup`` is told not to count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessel.llm._text import SPACED, chunks, lean, mix64, powers, words
from tessel.plans.lineage import Scratch, free_name

MIN_WORDS = 20


def _lines(buf: np.ndarray, offs: np.ndarray):
    """Lines with a word: (row, number of words before each and in all, hash prefix sums); text hash of each row."""
    w = words(buf, offs, SPACED)
    if not len(w.start):
        return None
    at = np.flatnonzero(buf == 10)
    of = np.searchsorted(at, w.start)
    new = np.ones(len(of), bool)
    new[1:] = (np.diff(of) > 0) | (np.diff(w.row) > 0)
    head = np.flatnonzero(new)
    count = np.append(head, len(w.start))
    pw, ipw = powers(len(w.hash) + 1)
    sums = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * pw[:-1], out=sums[1:])
    span = lambda lo, hi: mix64((sums[hi] - sums[lo]) * ipw[lo])
    return w.row[head], count, span(count[:-1], count[1:]), span(w.first[:-1], w.first[1:])


def windows(row: np.ndarray, count: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of every shortest stretch of ``least`` words, from either end, within a row."""
    n = len(row)
    s = np.arange(n)
    e = np.searchsorted(count, count[:-1] + least) - 1
    ok = e < n
    ok[ok] = row[e[ok]] == row[s[ok]]
    pairs = [np.stack([s[ok], e[ok]])]
    b = np.searchsorted(count, count[1:] - least, "right") - 1
    ok = b >= 0
    ok[ok] = row[b[ok]] == row[s[ok]]
    pairs.append(np.stack([b[ok], s[ok]]))
    p = np.unique(np.concatenate(pairs, 1), axis=1) if n else np.zeros((2, 0), np.int64)
    return p[0], p[1]


_AT = "struct<wh: long, s: int, e: int>"


def _fingerprints(least: int):
    fields = pa.struct([("wh", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("windows", pa.list_(fields))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, buf, offs in chunks(batch.column(1)):
                if (found := _lines(buf, offs)) is None:
                    continue
                row, count, line, text = found
                s, e = windows(row, count, least)
                if not len(s):
                    continue
                pick = s.copy()
                for j in range(1, int((e - s).max()) + 1):
                    k = np.minimum(s + j, e)
                    pick = np.where(line[k] < line[pick], k, pick)
                pw, ipw = powers(len(line) + 1)
                sums = np.zeros(len(line) + 1, np.uint64)
                np.cumsum(line * pw[:-1], out=sums[1:])
                whole = mix64((sums[e + 1] - sums[s]) * ipw[s] + (e - s + 1).astype(np.uint64))
                base = np.searchsorted(row, row)  # first line of each line's row
                order = np.argsort(pick, kind="stable")
                s, e, pick, whole = s[order], e[order], pick[order], whole[order]
                head = np.flatnonzero(np.append(True, np.diff(pick) > 0))
                at = pick[head]
                inner = pa.StructArray.from_arrays([pa.array(whole.astype(np.int64)), pa.array((s - base[s]).astype(np.int32)), pa.array((e - base[s]).astype(np.int32))], fields=list(fields))
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(pick)).astype(np.int32)), inner)
                yield pa.RecordBatch.from_arrays([pa.array(line[at].astype(np.int64)), pa.array(ids[lo + row[at]].astype(np.int64)), pa.array(text[row[at]].astype(np.int64)), lists.cast(schema.field("windows").type)], schema=schema)

    return of


def _delete(texts: int, ranges: int, schema: pa.Schema, counts: bool):
    """Rows with their ranges [(text hash, first, last)] in column ``ranges``: the lines of the ranges go."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(texts)
            out = col.to_pylist() if batch.num_rows else []
            drop = batch.column(ranges).to_pylist()
            n_lines, n_deleted = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
            for lo, hi, buf, offs in chunks(col):
                found = _lines(buf, offs)
                if found is None:
                    continue
                row, _, _, text = found
                n_lines[lo:hi] = np.bincount(row, minlength=hi - lo)
                for i in range(lo, hi):
                    mine = [(x["s"], x["e"]) for x in drop[i] or () if x["th"] == np.int64(text[i - lo].astype(np.int64))]
                    if mine:
                        gone = np.zeros(n_lines[i] + 1, np.int64)
                        for s, e in mine:
                            gone[s] += 1
                            gone[e + 1] -= 1
                        gone = np.cumsum(gone)[:-1] > 0
                        n_deleted[i] = gone.sum()
                        k, kept = -1, []
                        for line in out[i].split("\n"):
                            full = bool(line.strip(" \t\n\v\f\r"))
                            k += full
                            # a line without words goes with the line before it
                            if not (k >= 0 and gone[k]):
                                kept.append(line)
                        out[i] = "\n".join(kept)
            cols = [pa.array(out, schema.field(texts).type) if c == texts else batch.column(c) for c in range(batch.num_columns) if c != ranges]
            arrays = [*cols, pa.array(n_lines), pa.array(n_deleted)] if counts else cols
            yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return of


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, runs): for each document the windows [(th, s, e)] that occur before; th is the hash of the text they are in."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    with Scratch() as scratch:
        prints = scratch.cut(texts.mapInArrow(lean(_fingerprints(min_words)), f"h long, id long, th long, windows array<{_AT}>"))
        # tables of the joins' smaller sides are written first: Spark broadcasts them, or splits the other side's hot keys
        again = scratch.cut(prints.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"))
        around = scratch.cut(prints.join(again, "h", "left_semi").select("id", "th", F.inline("windows")))
        first = scratch.cut(around.groupBy("wh").agg(F.min(F.struct("id", "th", "s")).alias("first"), F.count("*").alias("m")).where("m > 1").select("wh", "first"))
        later = around.join(first, "wh").where(F.struct("id", "th", "s") > F.col("first")).select("id", "th", "s", "e").distinct()
        return scratch.keep(later.groupBy("id").agg(F.collect_list(F.struct("th", "s", "e")).alias("runs")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, counts: bool = True) -> DataFrame:
    """``docs`` with the lines of later repeated runs deleted from the text, and n_lines, n_deleted added if ``counts``."""
    own = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_deleted")]
    key, held = free_name("id", docs), free_name("runs", docs)
    runs = repeated_runs(docs, id_col, text_col, min_words).select(F.col("id").alias(key), F.col("runs").alias(held))
    rows = docs.join(runs, docs[id_col].cast("long") == F.col(key), "left").select(*[docs[c] for c in own], held)
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_deleted", T.LongType())]
    out = T.StructType([*[docs.schema[c] for c in own], *(added if counts else [])])
    return rows.mapInArrow(lean(_delete(own.index(text_col), len(own), to_arrow_schema(out), counts)), out)


ORACLE = r"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM p),
c AS (SELECT doc_id, i, line, len(ws) AS n, array_to_string(ws, ' ') AS said, CAST(sum(CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - 1 AS k FROM w),
f AS (SELECT doc_id, k, n, said, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS upto FROM c WHERE n > 0),
a AS (SELECT f.doc_id, f.k AS s, min(g.k) AS e FROM f JOIN f AS g ON g.doc_id = f.doc_id AND g.k BETWEEN f.k AND f.k + 19 WHERE g.upto - f.upto + f.n >= 20 GROUP BY ALL),
b AS (SELECT f.doc_id, max(g.k) AS s, f.k AS e FROM f JOIN f AS g ON g.doc_id = f.doc_id AND g.k BETWEEN f.k - 19 AND f.k WHERE f.upto - g.upto + g.n >= 20 GROUP BY f.doc_id, f.k),
u AS (SELECT doc_id, s, e FROM a UNION SELECT doc_id, s, e FROM b),
r AS (SELECT u.doc_id, u.s, u.e, string_agg(f.said, chr(10) ORDER BY f.k) AS run FROM u JOIN f ON f.doc_id = u.doc_id AND f.k BETWEEN u.s AND u.e GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS nth FROM r),
x AS (SELECT DISTINCT o.doc_id, f.k FROM o JOIN f ON f.doc_id = o.doc_id AND f.k BETWEEN o.s AND o.e WHERE nth > 1),
t AS (SELECT c.doc_id, coalesce(string_agg(c.line, chr(10) ORDER BY c.i) FILTER (WHERE x.k IS NULL), '') AS text,
  CAST(sum(CASE WHEN c.n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN c.n > 0 AND x.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_deleted
  FROM c LEFT JOIN x ON x.doc_id = c.doc_id AND x.k = c.k GROUP BY c.doc_id)
SELECT d.doc_id, t.text, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_deleted, 0) AS n_deleted FROM documents AS d LEFT JOIN t USING (doc_id)
"""
