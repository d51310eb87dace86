"""Near-duplicate removal by banded min-wise signatures of word n-grams.

The signature is computed in Arrow batches; buckets meet by one grouping with a minimum, so that a bucket of any size
gives one edge per member; the components' smallest ids represent them. Texts of fewer than n tokens have no n-grams:
with ``compat`` they all share the signature that nothing lowers, and so fall into one cluster; else they are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.geometry import optimal_bands
from tessel.operators.datasets import permutations
from tessel.operators.graph import connected_components

PRIME, MASK = np.uint64((1 << 61) - 1), np.uint64((1 << 32) - 1)
_SPLIT = re.compile(r"[^A-Za-z_0-9]")


def ngram_hashes(text: str, n: int) -> np.ndarray:
    words = _SPLIT.split(text)
    grams = {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
    return np.array([int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams], np.uint64)


def signature(text: str, perms: np.ndarray, n: int) -> np.ndarray:
    h = ngram_hashes(text, n)
    if not len(h):
        return np.full(perms.shape[1], MASK, np.uint64)
    return np.minimum(((h[:, None] * perms[0] + perms[1]) % PRIME & MASK).min(0), MASK)


def band_keys(rows: DataFrame, num_perm: int, bands: int, per_band: int, n: int, seed: int, compat: bool) -> DataFrame:
    """(id, band, key) for (id, text)."""
    perms = permutations(num_perm, seed)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"].fillna(""), strict=True):
                if not compat and len(_SPLIT.split(text)) < n:
                    continue
                s = signature(text, perms, n).astype(">u4")
                out += [(i, b, hashlib.md5(s[b * per_band : (b + 1) * per_band].tobytes()).hexdigest()) for b in range(bands)]
            yield pd.DataFrame(out, columns=["id", "band", "key"])

    return rows.mapInPandas(of, "id long, band int, key string")


def clusters(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, num_perm: int = 256, n: int = 5, seed: int = 42, compat: bool = True) -> DataFrame:
    """(id, cluster): the smallest id of each document's cluster; a document alone is its own."""
    bands, per_band = optimal_bands(threshold, num_perm)
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keys = band_keys(ids, num_perm, bands, per_band, n, seed, compat)
    least = keys.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count("*").alias("m")).where("m > 1").select("band", "key", "hub")
    edges = keys.join(least, ["band", "key"]).where("id <> hub").select("id", "hub").distinct()
    found = connected_components(edges, "id", "hub")
    base = ids.select("id") if compat else keys.select("id").distinct()
    return base.join(found, base["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("cluster"))


def representatives(docs: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """``docs`` with one document of each cluster, that of the smallest id."""
    kept = clusters(docs, id_col, text_col, **how).where("id = cluster").select(F.col("id").alias(id_col))
    return docs.join(kept, id_col, "left_semi")


def save_representatives(docs: DataFrame, path: str, id_col: str, text_col: str, **how) -> DataFrame:
    """Writes the representatives as Parquet and reads them."""
    representatives(docs, id_col, text_col, **how).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)
