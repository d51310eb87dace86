"""Token counts by offset-mapped attribution.

A document is encoded once, whole. The tokens' byte lengths give each one's span; spans and sections are then joined as
intervals, both sorted, by two binary searches. Sections are the document's lines, each with its line end, or ranges of
characters given in a column.

The rule for tokens that cross a boundary: a token belongs to the section that holds most of its bytes, of several as
much to the first. Every token that touches a section is attributed once, so that the sections' counts add up to the
document's; with sections given, tokens that touch none count as outside.

The vocabulary is a file of ranks, read by the driver and sent along with the functions, so that executors need no file.

Edge cases. Null and empty texts have no token and no section. Ranges are cut to the text; empty ones get 0. Sections
that overlap: the earlier in order takes what both hold. Special tokens' strings are ordinary text. Runs of white space
of any length are encoded as the pattern would split them, without its look-ahead, which cannot take very long ones.
Ties: of sections that hold as many bytes of a token the first gets it. Every row has its own result, also if rows are
equal; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._text import chunks

# Fixed value: the pattern by which the vocabulary splits a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space in a row beyond which a run is split off before the pattern sees it.
LONG = 1 << 13
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_loaded: dict = {}


def read_ranks(path: str) -> bytes:
    """A rank file: a token in base64 and its rank in each line."""
    return Path(path).read_bytes()


def encoder(ranks: bytes, pattern: str = PATTERN):
    """The encoding of a rank file's content, and the byte length of each id; made once in a process."""
    key = hashlib.md5(ranks).digest(), pattern
    if key not in _loaded:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        size = np.zeros(max(merges.values()) + 1, np.int64)
        for token, rank in merges.items():
            size[rank] = len(token)
        _loaded[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={}), size
    return _loaded[key]


def encode(enc, text: str, long: int = LONG) -> list[int]:
    """The tokens of a text. The pattern takes a run of white space as one piece, without its last character where
    something follows, and nothing crosses a run's start: so a long run can be cut out and merged by itself."""
    if len(text) <= long:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for m in re.finditer(f"(?<!{_SPACE}){_SPACE}{{{long},}}", text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])


def attribute(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each section and the number that cross a boundary; token k covers bytes ends[k - 1] to ends[k].

    ``bounds``: rising byte positions, section i from bounds[i] to bounds[i + 1], from 0 to the text's length.
    """
    starts = np.append(0, ends[:-1])
    lo = np.searchsorted(bounds, starts, "right") - 1
    hi = np.searchsorted(bounds, ends, "left") - 1
    where = lo.copy()
    crossing = np.flatnonzero(hi > lo)
    for k in crossing:
        over = [min(ends[k], bounds[i + 1]) - max(starts[k], bounds[i]) for i in range(lo[k], hi[k] + 1)]
        where[k] = lo[k] + int(np.argmax(over))
    return np.bincount(where, minlength=len(bounds) - 1), len(crossing)


def _lines(ranks: bytes):
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int64()), ("n_crossing", pa.int64()), ("section_start", pa.list_(pa.int32())), ("section_tokens", pa.list_(pa.int32()))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoder(ranks)
        for batch in batches:
            texts, rows = batch.column(1), []
            for lo, hi, buf, offs in chunks(texts):
                chars = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
                breaks = np.flatnonzero(buf == 10) + 1
                for i in range(lo, hi):
                    a, b = offs[i - lo], offs[i - lo + 1]
                    if a == b:
                        rows.append((0, 0, 0, [], []))
                        continue
                    ends = np.cumsum(size[np.asarray(encode(enc, texts[i].as_py()))])
                    inside = breaks[np.searchsorted(breaks, a, "right") : np.searchsorted(breaks, b)]
                    bounds = np.concatenate([[0], inside - a, [b - a]])
                    counts, crossing = attribute(ends, bounds)
                    rows.append((len(ends), len(counts), crossing, (chars[a + bounds[:-1]] - chars[a]).astype(np.int32), counts.astype(np.int32)))
            arrays = [batch.column(0)] + [pa.array([r[k] for r in rows], schema.field(k + 1).type) for k in range(5)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return of


def _ranges(ranks: bytes):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoder(ranks)
        for batch in batches:
            total, outside, counts = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ranges = ranges or []
                raw = np.frombuffer((text or "").encode(), np.uint8)
                at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                byte = [tuple(int(at[min(max(x or 0, 0), len(at) - 1)]) for x in (r["start"], r["end"])) for r in ranges]
                cuts = np.unique(np.array([0, len(raw), *[x for r in byte for x in r]], np.int64))
                ends = np.cumsum(size[np.asarray(encode(enc, text))]) if text else np.zeros(0, np.int64)
                owner = np.full(max(len(cuts) - 1, 0), len(ranges))
                for k in range(len(ranges) - 1, -1, -1):
                    owner[(cuts[:-1] >= byte[k][0]) & (cuts[1:] <= byte[k][1])] = k
                out = np.zeros(len(ranges) + 1, np.int64)
                for s, e in zip(np.append(0, ends)[: len(ends)], ends, strict=True):
                    held: dict = {}
                    for p in range(int(np.searchsorted(cuts, s, "right")) - 1, int(np.searchsorted(cuts, e, "left"))):
                        held[owner[p]] = held.get(owner[p], 0) + min(e, cuts[p + 1]) - max(s, cuts[p])
                    inner = {k: v for k, v in held.items() if k < len(ranges)}
                    out[max(inner, key=lambda k: (inner[k], -k)) if inner else len(ranges)] += 1
                total.append(len(ends))
                outside.append(int(out[-1]))
                counts.append(out[:-1].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(outside, pa.int64()), pa.array(counts, pa.list_(pa.int32()))], names=["id", "n_tokens", "n_outside", "section_tokens"])

    return of


def count_by_line(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_sections, n_crossing, section_start, section_tokens): the document's tokens by line."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_lines(read_ranks(vocabulary)), "id long, n_tokens long, n_sections long, n_crossing long, section_start array<int>, section_tokens array<int>")


def count_by_range(docs: DataFrame, vocabulary: str, ranges_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_outside, section_tokens) for sections given as array<struct<start, end>> of characters."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(ranges_col).alias("ranges"))
    return rows.mapInArrow(_ranges(read_ranks(vocabulary)), "id long, n_tokens long, n_outside long, section_tokens array<int>")
