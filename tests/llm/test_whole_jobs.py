"""Whole results where a short cut would lose some: widespread leaks, large benchmarks, forms of licences."""

import re

import numpy as np
import pytest

from tessel.llm import licenses, near_dedup
from tessel.llm.decontaminate import find_leaks
from tessel.plans.lineage import Scratch


@pytest.fixture(scope="module")
def zipf():
    rng = np.random.default_rng(11)
    vocabulary = np.array(["".join(rng.choice(list("abdeiklmnorstu"), rng.integers(2, 9))) for _ in range(4000)])
    p = 1 / np.arange(1, len(vocabulary) + 1)
    return rng, lambda n: list(rng.choice(vocabulary, n, p=p / p.sum()))


def test_leaks_in_a_third_of_all_documents(spark, zipf):
    _, text = zipf
    items = [text(40) for _ in range(5)]
    changed = [[w for k, w in enumerate(x) if k % 6 != 2] for x in items]
    docs, want = [], set()
    for i in range(600):
        words = text(220)
        if i % 3 == 0:
            for j, x in enumerate(items if i % 2 else changed):
                words[40 * j : 40 * j] = x
                want.add((i, j))
        docs.append((i, " ".join(words)))
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    got = {(r.id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == want


def test_copies_of_five_thousand_items(spark, zipf):
    rng, text = zipf
    items = [text(30) for _ in range(5000)]
    docs = []
    for i, x in enumerate(items):
        words = text(80)
        at = int(rng.integers(0, 80))
        docs.append((i, " ".join(words[:at] + x + words[at:])))
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    got = {(r.id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bench).collect()}
    assert {(i, i) for i in range(5000)} <= got
    assert len(got) < 5100


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_leaks_against_all_passages(spark, zipf):
    """Every document with a stretch that holds the share of an item in order is found; others are not."""
    rng, text = zipf
    items = [text(int(rng.integers(20, 45))) for _ in range(12)]
    docs = []
    for i in range(160):
        words = text(int(rng.integers(30, 160)))
        if i % 2:
            item = list(items[i % 12])
            kind = i % 8
            if kind == 3:  # words left out
                item = [w for k, w in enumerate(item) if k % 5 != 1]
            elif kind == 5:  # words replaced
                item = [w if k % 4 else "instead" for k, w in enumerate(item)]
            elif kind == 7:  # words put in between
                item = [x for k, w in enumerate(item) for x in ([w, "between"] if k % 3 == 0 else [w])]
            at = int(rng.integers(0, len(words)))
            words[at:at] = item
        docs.append((i, words))
    rows = [(i, " ".join(w)) for i, w in docs]
    rows.append(rows[1])  # an equal row is the same document
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    found = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    got = {(r.id, r.item_id) for r in found}
    assert len(got) == len(found)
    want = set()
    for i, w in docs:
        for j, x in enumerate(items):
            # passages of the item's length and a half
            if any(brute_lcs(x, w[k : k + len(x) * 3 // 2]) >= 0.7 * len(x) for k in range(0, max(1, len(w) - len(x) // 2), 4)):
                want.add((i, j))
    assert len(got & want) >= 0.9 * len(want) and len(want) >= 70
    assert all(brute_lcs(items[j], dict(docs)[i]) >= 0.5 * len(items[j]) for i, j in got)


def test_prefixes_meet_whatever_reaches_the_threshold(spark):
    """Links across labels are those of a comparison of all pairs, whatever is common to how many."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 62, 300)
    rows = []
    for i in range(120):
        base = pool[(i % 5) * 40 : (i % 5) * 40 + 60]
        own = rng.choice(base, int(rng.integers(40, 61)), replace=False)
        rows.append((i, int(i % 7), sorted({*own.tolist(), *rng.integers(0, 1 << 62, int(rng.integers(0, 12))).tolist()})))
    sets = spark.createDataFrame([(i, label, len(k), k) for i, label, k in rows], "rep long, label long, n long, keys array<long>")
    want = set()
    for i, a, x in rows:
        for j, b, y in rows:
            both = len(set(x) & set(y))
            if a != b and 100 * both >= 75 * (len(x) + len(y) - both):
                want.add((i, j))
    with Scratch() as scratch:
        got = {(r.a, r.b) for r in near_dedup._links_across(near_dedup._met(sets, scratch, 75), sets, scratch, 75).collect()}
    assert got <= want and want
    # documents of one label are one component already: a link to each other label is enough
    own = {(i, 1000 + a) for i, a, _ in rows}
    assert components(got | own) == components(want | own)


def components(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


NAMED = ['license = "mit"', 'license     = "mit"', "license\t= mit", "licence = mit", "licence=mit", "licence : isc", "license: zlib", "released under the gpl 3", "spdx-license-identifier: mit", "the isc licence", "https://opensource.org/licenses/mit", "subject to the terms of the mit license"]


def unfiltered(rules, text):
    return tuple(licenses.Rule(r.order, r.label, r.regex, r.priority, r.confidence, tuple(set(text))) for r in rules)


def test_rules_without_prefilter_and_containment_by_definition():
    """Random texts of phrases: the detections are those of all regexes, resolved by comparing all with all."""
    rng = np.random.default_rng(6)
    rules = licenses.default_rules()
    parts = [x for x, _ in KNOWN] + NAMED + ["under", "the", "license", "mit", "or", "apache-2.0", "dual-licensed under MIT or Apache-2.0", "GNU", "terms of", "bsd 3-clause license", "cc-by-nc 4.0", "submit", "limit"]
    for _ in range(60):
        text = " ".join(rng.choice(parts, int(rng.integers(1, 9)))).lower()
        found = sorted((-r.priority, m.start() - m.end(), m.start(), r.order, m.end(), k) for k, r in enumerate(rules) for m in re.finditer(r.regex, text))
        kept = []
        for _, _, start, _, end, k in found:
            if not any(a <= start and end <= b for a, b, _ in kept):
                kept.append((start, end, k))
        assert licenses.detect(text, rules) == [(a, b, rules[k].label, rules[k].confidence) for a, b, k in sorted(kept)]


def test_many_detections_in_time():
    import time

    text = "licensed under the mit license. apache license 2.0, " * 40_000
    began = time.process_time()
    assert len(licenses.detect(text, licenses.default_rules())) >= 80_000
    assert time.process_time() - began < 20


def test_both_of_a_dual_license():
    got = {x for _, _, x, _ in licenses.detect("dual-licensed under mit or apache-2.0.", licenses.default_rules())}
    assert got == {"mit", "apache-2"}


@pytest.mark.parametrize("text", NAMED)
def test_keywords_lose_no_license(text):
    rules = licenses.default_rules()
    every = unfiltered(rules, text)
    assert any(re.search(r.regex, text) for r in rules)
    assert licenses.detect(text, rules) == licenses.detect(text, every) != []


BSD = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted"
MIT = 'Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files (the "Software"), to permit persons to whom the Software is furnished to do so'
KNOWN = [
    ("terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or", "gpl-2"),
    ("GNU Lesser General Public License as published by the Free Software Foundation; either\nversion 2.1 of the License", "lgpl-2.1"),
    ("the GNU Affero General Public License as published by the Free Software Foundation, version 3", "agpl-3"),
    ("under version 3 of the GNU General Public License", "gpl-3"),
    ("GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991", "gpl-2"),
    ("Permission is hereby granted, free of charge", "mit"),
    (f"{MIT}, subject to\nthe following conditions:", "mit"),
    (f"{MIT}.", "mit-0"),
    (BSD, "bsd-2-clause"),
    (f"{BSD}. Neither the name of X may be used to endorse or promote products", "bsd-3-clause"),
    (f"{BSD}. All advertising materials mentioning features or use of this software must say so. X may not be used to endorse or promote", "bsd-4-clause"),
    ("Boost Software License - Version 1.0", "boost-1"),
    ("SIL Open Font License", "ofl"),
    ("Apache License\n   Version 2.0, January 2004", "apache-2"),
    ("released under the MIT\nLicense", "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that", "isc"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0bsd"),
    ("the Apache License of 2020, a boost in software, licensed by the GNU", None),
]


@pytest.mark.parametrize(("text", "label"), KNOWN)
def test_texts_and_notices_of_licenses(text, label):
    got = {x for _, _, x, _ in licenses.detect(text.lower(), licenses.default_rules())}
    assert got == ({label} if label else set())
