"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import language, mixing, quality, toxicity
from tessel.llm.decontaminate import find_leaks
from tessel.llm.html_text import extract
from tessel.llm.licenses import scan_licenses
from tessel.llm.line_dedup import line_dedup
from tessel.llm.near_dedup import near_duplicates
from tessel.llm.queries import VOCABULARY
from tessel.llm.token_spans import count_by_line
from tessel.plans.lineage import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, `rows` string"


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abdeiklmnorstu"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = [prose(rng, 60) for _ in range(12)]
    passage = prose(rng, 30)
    texts = [*base, base[0], base[0], base[1].replace(" ", "  "), base[2] + " tail end", base[3] + "\n" + passage, base[4] + "\n" + passage, passage + "\n" + base[5], "", None, " \n ", "one two", "one two", "long " * 20000 + base[6]]
    out = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", 0, 7, "k", "r") for i, t in enumerate(texts)]
    return [*out, out[0], (None, base[7], "en", "s1", 0, 7, "k", "r"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = [x.lower() for x in words(t)]
        if i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(docs, empty, rows):
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = brute_components(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_chain_and_of_unlike_members(spark):
    """Copies of a hub that are too unlike each other, and members that reach nobody."""
    rng = np.random.default_rng(8)
    hub = prose(rng, 120).split()
    rows = []
    for i in range(60):
        w = list(hub)
        for k in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            w[k] = f"edit{i}x{k}"
        rows.append((100 - i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def brute_lines(rows, least):
    """By definition: every run of whole lines with enough words that occurs before goes."""
    docs = sorted({(i, t) for i, t, *_ in rows if i is not None and t is not None})
    lines = {d: [tuple(x.lower() for x in words(x)) for x in d[1].split("\n") if words(x)] for d in docs}
    first, gone = {}, {d: set() for d in docs}
    for d in docs:
        own = lines[d]
        for s in range(len(own)):
            for e in range(s, len(own)):
                if sum(map(len, own[s : e + 1])) >= least:
                    run = tuple(own[s : e + 1])
                    if first.setdefault(run, (d, s)) != (d, s):
                        gone[d] |= set(range(s, e + 1))
    return {d[0]: [x for k, x in enumerate(lines[d]) if k not in gone[d]] for d in docs}


def test_line_dedup(docs, empty, rows):
    got = line_dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_deleted"]
    want = brute_lines(rows, 20)
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None and r.text is not None:
            assert [tuple(x.lower() for x in words(x)) for x in r.text.split("\n") if words(x)] == want[r.doc_id], r.doc_id
    assert sum(r.n_deleted for r in out) > 0
    assert [r.text for r in out if r.doc_id is None and r.lang == "en"] == [r[1] for r in rows if r[0] is None and r[2] == "en"]
    assert line_dedup(empty).count() == 0


def test_line_dedup_within_a_text(spark):
    line = " ".join(f"w{i}" for i in range(25))
    text = f"{line}\nshort\n{line}\n\n{line}\nend"
    got = line_dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.text == f"{line}\nshort\nend" and got.n_deleted == 2


def test_mix(docs, empty, rows):
    got = mixing.mix(mixing.sizes(docs)).collect()
    assert len(got) == len(rows)
    total = sum(len(words(r[1])) for r in rows)
    targets = {r.source: (r.source_size, r.target) for r in got}
    assert sum(t for _, t in targets.values()) == pytest.approx(1.5 * total)
    for s, (size, target) in targets.items():
        assert target <= 2 * size + 1e-6
        largest = max(r.size for r in got if r.source == s)
        assert abs(sum(r.taken for r in got if r.source == s) - target) <= largest
    assert all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(mixing.sizes(empty)).count() == 0
    applied = mixing.apply_mix(docs)
    assert applied.columns == [*docs.columns, "mix_copies"]
    assert applied.count() == sum(r.copies > 0 for r in got)


def test_find_leaks(spark, docs, empty, rows):
    whole = words(rows[8][1])
    items = [(1, " ".join(whole[10:45])), (2, "Nothing of this kind is in there at all, truly."), (3, None), (4, ""), (5, " ".join(w for k, w in enumerate(whole[5:50]) if k % 9))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item_id): r for r in find_leaks(docs, bench).collect()}
    assert set(got) == {(8, 1), (8, 5)}
    assert got[8, 1].lcs == 1.0
    assert find_leaks(docs, bench.limit(0)).count() == 0
    assert find_leaks(empty, bench).count() == 0


def test_quality(docs, empty, rows):
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed) and (r.distance is None) == r.base_failed
    assert len({(r.kept, r.distance) for r in got if r.id == 0}) == 1  # equal rows are judged alike
    assert quality.judge(empty).count() == 0


def concentrate(x, mean, cov, floor, steps=30):
    for _ in range(steps):
        d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov + floor), x - mean)
        half = x[np.argsort(d, kind="stable")[: -(-len(x) // 2)]]
        mean, cov = half.mean(0), np.cov(half.T, bias=True)
    return np.linalg.slogdet(cov + floor)[1], mean, cov


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_least_determinant_against_many_starts(spark, seed):
    """The half found has about the determinant of the best that 300 random starts find, and the same outliers."""
    rng = np.random.default_rng(seed)
    shape = rng.normal(size=(5, 5))
    x = rng.normal(size=(60, 5)) @ shape
    x[:18] = rng.normal(size=(18, 5)) * 0.3 + 25 * rng.normal(size=5)  # a tight bunch far off
    floor = np.diag(np.square(quality.FLOOR))
    best = min((concentrate(x, s.mean(0), np.cov(s.T, bias=True), floor) for s in (x[rng.choice(60, 8, replace=False)] for _ in range(300))), key=lambda e: e[0])
    rows = spark.createDataFrame([(("en", "s", False), *map(float, v)) for v in x], "g struct<lang: string, source: string, every: boolean>, v0 double, v1 double, v2 double, v3 double, v4 double")
    with Scratch() as scratch:
        got = quality.least_determinant(rows, scratch).first()
    assert got.logdet <= best[0] + 0.7
    far = lambda mean, cov: np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov + floor), x - mean)
    ours, theirs = far(np.array(got["mean"]), np.array(got["cov"]).reshape(5, 5)), far(*best[1:])
    assert ours[:18].min() > 10 * np.median(ours) and theirs[:18].min() > 10 * np.median(theirs)


def test_quality_rejects_an_outlier(spark):
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, int(rng.integers(40, 200))), "en", "s") for i in range(150)]
    rows += [(1000, " ".join(w + "###$$$" for w in prose(rng, 80).split()), "en", "s")]
    got = {r.id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[1000].kept and not got[1000].base_failed
    assert sum(not got[i].kept for i in range(150)) == 0


def test_language_and_toxicity_without_labels(spark, docs, empty, rows):
    model = language.fit(docs)
    got = language.predict(docs, model).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"en", "und"}
    assert language.predict(docs, language.fit(empty)).where("lang_pred <> 'und'").count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    assert scored.count() == len(rows) and scored.agg(F.max("tox_score")).first()[0] < 1e-6
    assert toxicity.score_documents(empty, toxicity.fit(empty, labels)).count() == 0


def test_scans(docs, empty, rows):
    assert scan_licenses(docs).count() == len(rows) and scan_licenses(empty).count() == 0
    counted = count_by_line(docs, VOCABULARY).collect()
    assert len(counted) == len(rows) and all(sum(r.section_tokens) == r.n_tokens for r in counted)
    assert count_by_line(empty, VOCABULARY).count() == 0


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>A b.</p></article>", "x"), (2, None, None, "x"), (1, "u", "<article><p>A b.</p></article>", "x")], "page_id long, url string, html string, text string")
    assert [(r.id, r.text, r.n_chars) for r in extract(pages).orderBy("id").collect()] == [(1, "A b.", 4), (1, "A b.", 4), (2, "", 0)]
