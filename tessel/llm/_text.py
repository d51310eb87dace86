"""Arrow-batch text kernels: words, hashes and windows over the raw UTF-8 bytes of a batch.

Spark hands string columns to Python as Arrow buffers: one byte buffer and the offsets of the rows in it. Everything
here works on those two arrays at once, so the cost of a document is the cost of its bytes and not of its words as
Python objects. All separators used are ASCII, and no byte of a multi-byte UTF-8 character is ASCII, so splitting the
bytes is the same as splitting the characters.

Hashes are 64-bit. A word's hash is a polynomial over a table of random byte values, read off a prefix sum, and mixed.
"""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[LOWER]

#: Word bytes of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True
#: Word bytes that are letters of ASCII or part of any character beyond it.
LETTERS = ALNUM.copy()
LETTERS[48:58] = False

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def lean(of):
    """The Arrow function ``of``, after whose last batch the worker gives memory that it holds unused back: workers are kept
    for later tasks, and what one task needed for a moment would stay with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from of(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
            if trim:
                trim(0)

    return run


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Words:
    """Words of a chunk of rows: byte range, row, and 64-bit hash; first[i] is the index of row i's first word."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    prefix: np.ndarray | None = None


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``limit`` bytes; no row is split."""
    data, at = strings(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray = SPACED, lower: bool = True, keep_prefix: bool = False) -> Words:
    """All words of all rows, in order."""
    n = len(buf)
    first = np.zeros(len(offs), np.int64)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), first)
    is_word = table[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1] | edge[1:n]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    pw, ipw = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * pw, out=sums[1:])
    return Words(start, end, row, mix64((sums[end] - sums[start]) * ipw[start]), first, sums if keep_prefix else None)


def span_hash(w: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of the chunk; w must keep its prefix sums. Equal to a word's hash over the same bytes."""
    _, ipw = powers(len(w.prefix) - 1)
    return mix64((w.prefix[end] - w.prefix[start]) * ipw[start])


def hash_word(word: str | bytes, lower: bool = True) -> int:
    """The hash that ``words`` gives this word."""
    b = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    pw, _ = powers(len(b))
    return int(mix64(np.array([((_BYTE_LOWER if lower else _BYTE)[b] * pw).sum(dtype=np.uint64)]))[0])


def fold(h: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hashes of every ``size`` consecutive items; len(h) - size + 1 of them."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = h[:n].copy()
    for j in range(1, size):
        s *= np.uint64(0x9DDFEA08EB382D69)
        s += h[j : j + n]
        s ^= s >> np.uint64(31)
    return mix64(s)


def crc_mod(ids: list, m: int = 3) -> np.ndarray:
    """crc32 of each id as decimal text, modulo m; a null id counts as the text ''."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % m for x in ids], np.int64)
