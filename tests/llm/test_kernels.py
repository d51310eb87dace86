"""Kernels against plain Python, without Spark."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessel.llm import decontaminate, html_text, language, licenses, line_dedup, near_dedup, quality, token_spans, toxicity
from tessel.llm._text import ALNUM, SPACED, chunks, hash_word, words
from tessel.llm.queries import VOCABULARY

RANKS = token_spans.read_ranks(VOCABULARY)
TEXTS = [
    "The quick Brown\tfox\nthe quick brown fox\n",
    "",
    None,
    " \n\t ",
    "é è x ñandú 漢字 漢字",
    "one\n\none\n \none | two ### & <b>\n",
    "a b c d e f g h a b c d e f g h z",
    "w " * 5000,
    "x" * 3_000_000,
    "Released under the MIT License.\nLicensed under the Apache License, Version 2.0. cc-by-nc 4.0",
]


def batch(*columns):
    return pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], names=[f"c{i}" for i in range(len(columns))])


def run(fn, *columns):
    return pa.Table.from_batches(list(fn(iter([batch(*columns)])))).to_pylist()


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize(("table", "split"), [(SPACED, spaced), (ALNUM, alnum)])
@pytest.mark.parametrize("limit", [1, 40, 2 << 20])
def test_words(table, split, limit):
    column = pa.array(TEXTS[:7] + TEXTS[9:])
    seen = {}
    for lo, hi, buf, offs in chunks(column, limit):
        w = words(buf, offs, table)
        for i in range(lo, hi):
            a, b = w.first[i - lo], w.first[i - lo + 1]
            got = [bytes(buf[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)]
            assert [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in got] == [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in split(column[i].as_py())]
            for x, h in zip(got, w.hash[a:b], strict=True):
                assert seen.setdefault(x.lower() if x.isascii() else x, int(h)) == int(h) == hash_word(x)


def test_statistics():
    got = run(quality.statistics, list(range(len(TEXTS))), ["en"] * len(TEXTS), [None] * len(TEXTS), pa.array(TEXTS))
    for r, text in zip(got, TEXTS, strict=True):
        w = spaced(text)
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if spaced(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        mark = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), dup, len(mark))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want


def test_chi_square():
    assert quality.chi_square(0.5, 5) == pytest.approx(4.351, abs=0.02)
    assert quality.chi_square(0.99, 5) == pytest.approx(15.09, abs=0.1)


def test_shingles_and_signatures():
    column = pa.array(["a b c d e f", "A B c d e F", "a b", "", None, "a b c d e x"])
    (_, _, buf, offs) = next(chunks(column))
    sets = near_dedup.shingle_sets(words(buf, offs), 6)
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 2] and (sets[0] == sets[1]).all()
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    pairs = [np.unique(base), np.unique(np.append(base[:300], rng.integers(0, 2**63, 100).astype(np.uint64)))]
    sig = near_dedup.signatures(pairs, 512)
    assert (sig[0] == sig[1]).mean() == pytest.approx(300 / 500, abs=0.08)
    assert near_dedup.band_keys(sig, 128, 4).shape == (2, 128)


def test_confirm_is_exact():
    a = " ".join(map(str, range(104)))  # 100 shingles
    near = a.rsplit(" ", 14)[0] + " " + " ".join(f"x{i}" for i in range(14))  # 86 shared of 114: 75.4 %
    far = a.rsplit(" ", 15)[0] + " " + " ".join(f"x{i}" for i in range(15))  # 85 of 115: 73.9 %
    got = run(near_dedup._confirm(75, 5), pa.array([1, 1, 1, 9], pa.int64()), pa.array([1, 2, 3, 9], pa.int64()), pa.array([a, near, far, ""]))
    assert [(r["a"], r["b"]) for r in got] == [(1, 2)]


def test_windows_hold_enough_words():
    rng = np.random.default_rng(0)
    row = np.sort(rng.integers(0, 5, 60))
    size = rng.integers(1, 12, 60)
    count = np.append(0, np.cumsum(size))
    s, e = line_dedup.windows(row, count, 15)
    got = set(zip(s.tolist(), e.tolist(), strict=True))
    want = set()
    for i in range(60):
        for j in range(i, 60):
            total = size[i : j + 1].sum()
            if row[i] == row[j] and total >= 15 and (total - size[j] < 15 or total - size[i] < 15):
                want.add((i, j))
    # every shortest stretch, seen from either end
    assert got == {(i, j) for i, j in want if size[i:j].sum() < 15 or size[i + 1 : j + 1].sum() < 15}


def test_passages_cover_all_words():
    first = np.array([0, 0, 10, 110, 110, 158])
    row, lo, hi = decontaminate.passages(first, 48, 24)
    for r in range(5):
        held = {k for a, b in zip(lo[row == r], hi[row == r], strict=True) for k in range(a, b)}
        assert held == set(range(first[r], first[r + 1]))


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 20)).astype(np.uint64), rng.integers(0, 6, rng.integers(0, 25)).astype(np.uint64)
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a, b) == t[-1, -1]


def test_license_base_and_rules():
    rules = licenses.default_rules()
    assert len(rules) > 200
    got = run(licenses._scan(rules, licenses.BASE), pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS))
    for r, text in zip(got, TEXTS, strict=True):
        w = alnum(text)
        places = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[-1]["labels"] == "apache-2,cc-by-nc,mit"


def test_license_containment():
    found = licenses.detect("licensed under the gnu general public license, version 3. spdx-license-identifier: mit", licenses.default_rules())
    assert [x[2] for x in found] == ["gpl-3", "mit"]
    for i, a in enumerate(found):
        assert not any(a[0] >= b[0] and a[1] <= b[1] for j, b in enumerate(found) if i != j)


def test_token_attribution():
    counts, crossing = token_spans.attribute(np.array([2, 5, 6, 10]), np.array([0, 4, 6, 10]))
    assert counts.tolist() == [2, 1, 1] and crossing == 1  # bytes 2 to 5 lie mostly in the first
    texts = [t for t in TEXTS[:7]]
    got = run(token_spans._lines(RANKS), pa.array(range(7), pa.int64()), pa.array(texts))
    enc, size = token_spans.encoder(RANKS)
    for r, text in zip(got, texts, strict=True):
        ids = enc.encode_ordinary(text or "")
        assert r["n_tokens"] == len(ids) == sum(r["section_tokens"]) and enc.decode(ids) == (text or "")

        owners, at = Counter(), 0
        raw = (text or "").encode()
        for i in ids:
            span = Counter(raw[:k].count(b"\n") for k in range(at, at + int(size[i])))
            owners[max(span, key=lambda s: (span[s], -s))] += 1
            at += int(size[i])
        assert [owners[k] for k in range(r["n_sections"])] == r["section_tokens"]


@pytest.mark.parametrize("text", ["a" + " " * 37 + "b c", " " * 40, "\n" * 33 + "x", "it's\u2003\u2003" * 5 + "\t" * 50 + "1 2", " a" + "\r\n" * 30, "x" + " " * 31 + "y" + " " * 32 + "z" + " " * 33])
def test_long_white_space_is_split_as_the_pattern_does(text):
    enc, _ = token_spans.encoder(RANKS)
    assert token_spans.encode(enc, text, 16) == enc.encode_ordinary(text)


@pytest.mark.parametrize("of", [" ", "\n", "x", "#", "\u3000", "1"])
def test_very_long_runs(of):
    for text in (of * 1_000_000, "a" + of * 1_000_000 + "b"):
        got = run_lines(text)
        assert sum(got["section_tokens"]) == got["n_tokens"] > 0
        assert got["n_sections"] == text.count("\n") + (not text.endswith("\n"))


def run_lines(text):
    return run(token_spans._lines(RANKS), pa.array([1], pa.int64()), pa.array([text]))[0]


def test_token_ranges():
    ranges = pa.array([[{"start": 0, "end": 2}, {"start": 2, "end": 99}], [], None])
    got = run(token_spans._ranges(RANKS), pa.array([1, 2, 3], pa.int64()), pa.array(["é a b c", "a b", None]), ranges)
    assert [sum(r["section_tokens"]) + r["n_outside"] == r["n_tokens"] for r in got] == [True] * 3
    assert got[1]["n_outside"] == 2 and got[2]["n_tokens"] == 0


def test_html_blocks_and_model():
    page = "<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body><nav><a href=x>Home</a></nav><article><h1>Big &amp; bold</h1><p>One  <b>two</b>\nthree.<p>Four&nbsp;five.<div class=ad>Buy</div></article><footer>&copy; me</footer><p"
    assert [b.text for b in html_text.blocks(page)] == ["Home", "Big & bold", "One two three.", "Four five.", "Buy", "© me"]
    assert html_text.blocks("") == [] and html_text.blocks("<p") == [] and html_text.blocks("<!-- x")  == []
    model = html_text.default_model()
    found = html_text.blocks(page)
    assert [b.text for b, y in zip(found, model.decode(found), strict=True) if y] == ["Big & bold", "One two three.", "Four five."]
    wrong = total = 0
    for html, content in html_text.labelled_pages(80, seed=5):
        found, y = html_text.label(html, content)
        wrong += sum(a != b for a, b in zip(model.decode(found), y, strict=True))
        total += len(y)
    assert wrong / total < 0.02
    got = run(html_text._extract(model), pa.array([1, 2], pa.int64()), pa.array([None, "u"]), pa.array([None, page]))
    assert [r["n_chars"] for r in got] == [0, len(got[1]["text"])]


HELD = [
    ("<article><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds.</p></article>", ["Energy E=m holds."]),
    ("<article><p>before</p><select><option>x<p>after one</p><p>after two</p></article>", ["before", "after one", "after two"]),
    ("<p>a <select><option>x<option>y</select> b</p>", ["a b"]),
    ("<div>a <svg><text>b</text></svg> <object>c</object> <canvas>d</canvas>", ["a b c d"]),
    ("<p>a<textarea>x", ["a"]),
    ("<p>a<div>b</p>c</div>d", ["a", "b", "c", "d"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("a < b &lt; c &amp;amp; d&#x21;", ["a < b < c &amp; d!"]),
]


@pytest.mark.parametrize(("page", "want"), HELD)
def test_blocks_lose_no_text(page, want):
    assert [b.text for b in html_text.blocks(page)] == want


def test_deep_and_long_pages_in_linear_time():
    import time

    model = html_text.default_model()
    known = model.known()
    for inner in ("<div class=c{i}>w{i} ", "<b id=x{i}>w{i} ", "<p><span>w{i}", "</i></div><t{i}>w{i} "):
        took = []
        for size in (4000, 16000):
            page = "".join(inner.format(i=i) for i in range(size))
            began = time.process_time()
            found = html_text.blocks(page, known)
            model.decode(found)
            took.append(time.process_time() - began)
            assert sum(len(b.text.split()) for b in found) == size
        assert took[1] < 10 * took[0] + 0.5, inner


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    crf = html_text.Crf({"a": 0}, rng.normal(size=(1, 2)), rng.normal(size=(2, 2)))
    scores = rng.normal(size=(6, 2))
    crf.scores = lambda page: scores
    value = lambda y: sum(scores[i, k] for i, k in enumerate(y)) + sum(crf.chain[a, b] for a, b in zip(y, y[1:], strict=False))
    best = max(([(n >> i) & 1 for i in range(6)] for n in range(64)), key=value)
    assert crf.decode([None] * 6) == best


def test_toxicity_learns_sentences():
    rng = np.random.default_rng(0)
    vocabulary = [f"word{i}" for i in range(200)]
    docs, y = [], []
    for i in range(400):
        sentences = [" ".join(rng.choice(vocabulary, 6)) for _ in range(rng.integers(1, 8))]
        y.append(int(i % 4 == 0))
        if y[-1]:
            sentences[int(rng.integers(0, len(sentences)))] += f" badword{rng.integers(0, 30)}"
        docs.append(". ".join(sentences) + ".")
    got = pa.Table.from_batches(list(toxicity._gather(iter([batch(pa.array(y, pa.int32()), pa.array(docs), pa.array(range(len(y)), pa.int64()))]))))
    model = toxicity.fit_arrays(got["toxic"].to_numpy(), got["x"].to_pylist(), got["sizes"].to_pylist())
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    schema = pa.schema([("t", pa.string()), ("s", pa.float64()), ("o", spans)])
    new = ["é word1 word2. Word3 badword77 word4! word5.", "word1 word2. word9.", "", None, "123 ..."]
    out = pa.Table.from_batches(list(toxicity._scorer(model, 0, schema, 0.5)(iter([batch(pa.array(new))])))).to_pylist()
    assert out[0]["s"] >= 0.7 and out[1]["s"] < 0.3 and [r["s"] for r in out[2:]] == [0, 0, 0]
    assert [new[0][o["start"] : o["end"]] for o in out[0]["o"]] == ["Word3 badword77 word"]


def test_language_centroids():
    rng = np.random.default_rng(0)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["zu", "wé", "tr"]}
    made = lambda lang: " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(30))
    texts = [made(lang) for lang in ("aa", "bb") for _ in range(20)]
    x = np.concatenate([language.counts(b, o) for _, _, b, o in language._pieces(pa.array(texts))])
    idf = np.log(41 / ((x > 0).sum(0) + 1)).astype(np.float32) + np.float32(0.1)
    u = language._unit(x * idf)
    c = [language._kmeans(u[:20], 2), language._kmeans(u[20:], 2)]
    model = language.Centroids(["aa", "bb"], np.array([0, 0, 1, 1]), np.concatenate(c), np.zeros(4), idf)
    got = run(language._predict(model), pa.array(range(6), pa.int64()), pa.array([made("aa"), made("bb"), "", None, "12 34", "x"]))
    assert [r["lang_pred"] for r in got][:5] == ["aa", "bb", "und", "und", "und"] and got[5]["lang_pred"] in ("aa", "bb")
    assert all(0 <= r["score"] <= 1 for r in got)
