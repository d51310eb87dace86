"""Registered queries read the whole of their tables."""

import numpy as np
import pytest

from tessel import catalog
from tessel.operators import datasets as D
from tessel.operators import dedup


def fold(groups, size):
    """Whole groups packed one after the other and padded, word for word."""
    every = [(s, x) for s, items in groups for x in items]
    done, now, sig = [], [], ""
    for s, items in groups:
        if now and len(now) + len(items) > size:
            done.append((now, sig))
            now = []
        sig = sig if now else s
        now = now + items
        if len(now) >= size:
            done.append((now, sig))
            now = []
    done += [(now, sig)] if now else []
    out = []
    for b, (own, sig) in enumerate(done):
        own = own[:size]
        pool = list(dict.fromkeys([x for s, x in every if s == sig and x not in own] + [x for s, x in every if s != sig and x not in own]))
        more = (pool + own * size)[: size - len(own)]
        out += [(b, x, False) for x in own] + [(b, x, True) for x in more]
    return out


@pytest.mark.parametrize("size", [4, 8])
def test_packing_against_a_fold(spark, size):
    rng = np.random.default_rng(size)
    groups = [(f"s{rng.integers(0, 9)}", [int(x) for x in rng.integers(0, 60, rng.integers(1, 6))]) for _ in range(60)] + [("alone", [1000])]
    df = spark.createDataFrame([(i, s, x) for i, (s, x) in enumerate(groups)], "group_pos long, signature string, items array<long>")
    got = [tuple(r) for r in D.pack_groups(df, size, pad=True).collect()]
    assert got == fold(groups, size)


def test_packed_batches_hold_all_orders(spark, tmp_path):
    orders = [(k, list(range(1, 2 + k % 7))) for k in range(1900, 2200, 3)]
    lines = spark.createDataFrame([(k, n) for k, ns in orders for n in ns], "l_orderkey long, l_linenumber int")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.queries()["l3_l4_packed_batches"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == fold([("s", [10 * k + n for n in ns]) for k, ns in orders], 8)


def test_near_dedup_takes_all_permutations(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "i j k l m n o p")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    asked = []
    make = dedup.permutations
    monkeypatch.setattr(dedup, "permutations", lambda n, seed: asked.append(n) or make(n, seed))
    assert {tuple(r) for r in catalog.queries()["j13_a27_minhash_clusters"](spark, str(tmp_path)).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert {r.doc_id for r in catalog.queries()["w8_cluster_representatives"](spark, str(tmp_path)).collect()} == {1, 3}
    assert set(asked) == {256}
