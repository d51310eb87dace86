"""Vector expressions over array columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if either is null."""
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column, eps: float = EPS) -> Column:
    """The vector of length 1; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(_doubles(v), lambda x: x / n)


def cosine(a: Column, b: Column, eps: float = EPS) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def pairwise_distance(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Euclidean distance with eps added to every difference."""
    return F.sqrt(F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x - y + F.lit(eps)), F.lit(0.0), lambda s, x: s + x * x))


def max_sim(query: Column, passage: Column) -> Column:
    """Late interaction: the sum over query vectors of the largest inner product with a passage vector; no padding."""
    best = F.transform(query, lambda q: F.array_max(F.transform(passage, lambda p: dot(q, p))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def slices(v: Column, size: int, count: int) -> Column:
    """A flat vector as ``count`` vectors of ``size``."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice(v, i * size + 1, F.lit(size)))


def last_token(hidden: Column, mask: Column) -> Column:
    """The hidden state at the last position of the attention mask."""
    return F.try_element_at(hidden, F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int")))
