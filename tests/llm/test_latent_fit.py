import numpy as np

from tessel.llm import decontaminate as D
from tessel.llm._text import hash_word
from tessel.plans.lineage import Scratch


def test_basis_comes_from_all_passages(spark):
    """60,000 passages: the basis is the one that numpy makes of all of them, window by window."""
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"word{k}" for k in range(150)])
    texts = [rng.choice(150, 10, p=p) for p in rng.dirichlet(np.full(150, 0.3), 30) for _ in range(1000)]
    docs = spark.createDataFrame([(" ".join(vocabulary[x]),) for x in texts] + [(None,), ("",)], "text string").repartition(5)
    bucket = np.array([hash_word(str(w)) >> (64 - D.BITS) for w in vocabulary])
    item = rng.choice(150, 9)
    with Scratch() as scratch:
        (made,) = D.fit_latent(docs, [[bucket[item]]], scratch, rank=6, window=8, stride=4)
        got = made.basis / made.idf[:, None]

    passages = [x[k : k + 8] for x in texts for k in (0, 4)]
    assert len(passages) == 60_000
    places, cell = np.unique(bucket, return_inverse=True)
    counts = np.zeros((len(passages) + 1, len(places)))
    for i, x in enumerate([*passages, item]):
        np.add.at(counts[i], cell[x], 1)
    idf = np.log((len(passages) + 1) / ((counts[:-1] > 0).sum(0) + 1)) + D.LEAST_IDF
    a = counts * idf
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    a[-1] *= np.sqrt(len(passages))  # the item weighs as much as all passages
    q = np.linalg.qr(a.T @ (a @ D._start(6 + D.OVERSAMPLE)[places]))[0]
    want = q @ np.linalg.eigh(q.T @ (a.T @ (a @ q)))[1][:, ::-1][:, :6]
    assert np.abs(made.idf[places] - idf).max() < 1e-5
    apart = np.abs(got[places] @ got[places].T - want @ want.T).max()
    assert apart < 2e-4, apart


def test_pieces_give_the_products_of_whole_passages(monkeypatch):
    """Sums over pieces, frequent buckets by a matrix product, are those of each passage's own words: short, long and cut ones."""
    monkeypatch.setattr(D, "_OFTEN", 7)
    rng = np.random.default_rng(8)
    size = np.array([0, 1, 3, 8, 9, 12, 13, 700, 0, 5])
    b = np.minimum(rng.geometric(0.02, size.sum()) - 1, (1 << D.BITS) - 1)
    _, lo, hi = D.passages(np.append(0, np.cumsum(size)), 8, 4)
    idf = D.smoothed_idf(np.bincount(b, minlength=1 << D.BITS), len(lo))
    counts = np.zeros((len(lo), 1 << D.BITS))
    for i in range(len(lo)):
        np.add.at(counts[i], b[lo[i] : hi[i]], 1)
    table = rng.standard_normal((1 << D.BITS, 6)).astype(np.float32)
    pieces = D._pieces(idf, D._often(idf), b, lo, hi, 4)
    assert np.abs(pieces.norm - np.linalg.norm(counts * idf, axis=1)).max() < 1e-3
    assert np.abs(pieces.sums(table) - counts @ table).max() < 1e-4
    y, out = rng.standard_normal((len(lo), 6)).astype(np.float32), np.zeros((1 << D.BITS, 6), np.float32)
    pieces.scatter(y, out)
    assert np.abs(out - counts.T @ y).max() < 1e-4
    pair, n = D._counts(b, lo, hi)
    assert (n == counts[pair >> D.BITS, pair & ((1 << D.BITS) - 1)]).all() and len(n) == (counts > 0).sum()
