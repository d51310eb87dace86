"""License scans by ordered signature rules behind a keyword prefilter.

A rule is a regex with keywords, words of its licence, a label, a priority and a confidence. An Aho-Corasick automaton
finds the keywords in the lower-cased text; only rules of a keyword and of a licence's word that are there are tried. Detections are then resolved in order of
priority, length and start: one whose characters lie within those of a detection accepted before is suppressed. The
rules come from a table of licences and from forms in which licences are named (full names, SPDX tags, headers, grants
and addresses), and from the sentences by which a licence's text or its standard notice is known. Words may be parted by
any white space, in sentences also by punctuation and the marks of comments.

Base phrases are found on words, apart from the rules, and their labels are never suppressed.

Edge cases. A null text is empty: no words, no labels, score 0. Text of any length is scanned as a whole, and its
detections are resolved in n log n. Ties: of detections of equal priority, length and start the rule that comes first in
the table stands. Every row has its own result, also if rows are equal; an empty table gives an empty one. Other columns
are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._text import ALNUM, LOWER, chunks, hash_word, words

# The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: (label, SPDX id, name as a regex, address as a regex, words): the licences known. Every name, id and address has one of
#: the words, or a word that begins so.
LICENCES = (
    ("mit", "mit", r"mit(?:/x11)?|expat", r"opensource\.org/licenses?/mit", "mit expat"),
    ("mit-0", "mit-0", r"mit no attribution", r"opensource\.org/licenses?/mit-0", "mit"),
    ("apache-1.1", "apache-1.1", r"apache(?: software)? licen[cs]e,? (?:version |v)1\.1", r"apache\.org/licenses/license-1\.1", "apache"),
    ("apache-2", "apache-2.0", r"apache(?: software)? licen[cs]e,? (?:version |v)?2(?:\.0)?", r"apache\.org/licenses/license-2\.0", "apache"),
    ("gpl-1", "gpl-1.0", r"gnu general public licen[cs]e,? (?:version |v)1(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0", "gnu gpl"),
    ("gpl-2", "gpl-2.0", r"(?:gnu general public licen[cs]e|gnu gpl|gpl),? ?(?:version |v)?2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", "gnu gpl"),
    ("gpl-3", "gpl-3.0", r"(?:gnu general public licen[cs]e|gnu gpl|gpl),? ?(?:version |v)?3(?:\.0)?", r"gnu\.org/licenses/gpl(?:-3\.0)?", "gnu gpl"),
    ("lgpl-2", "lgpl-2.0", r"gnu library general public licen[cs]e,? (?:version |v)?2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0", "gnu lgpl"),
    ("lgpl-2.1", "lgpl-2.1", r"(?:gnu lesser general public licen[cs]e|lgpl),? ?(?:version |v)?2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", "gnu lgpl"),
    ("lgpl-3", "lgpl-3.0", r"(?:gnu lesser general public licen[cs]e|lgpl),? ?(?:version |v)?3(?:\.0)?", r"gnu\.org/licenses/lgpl(?:-3\.0)?", "gnu lgpl"),
    ("agpl-3", "agpl-3.0", r"(?:gnu affero general public licen[cs]e|agpl),? ?(?:version |v)?3(?:\.0)?", r"gnu\.org/licenses/agpl(?:-3\.0)?", "gnu agpl"),
    ("gfdl", "gfdl-1.3", r"gnu free documentation licen[cs]e", r"gnu\.org/licenses/fdl", "gnu gfdl"),
    ("bsd-2-clause", "bsd-2-clause", r"(?:2-clause|two-clause|simplified|freebsd) bsd|bsd[ -](?:2-clause|two-clause)", r"opensource\.org/licenses?/bsd-2-clause", "bsd freebsd"),
    ("bsd-3-clause", "bsd-3-clause", r"(?:3-clause|three-clause|new|modified|revised) bsd|bsd[ -](?:3-clause|three-clause)", r"opensource\.org/licenses?/bsd-3-clause", "bsd"),
    ("bsd-4-clause", "bsd-4-clause", r"(?:4-clause|four-clause|original) bsd|bsd[ -](?:4-clause|four-clause)", r"spdx\.org/licenses/bsd-4-clause", "bsd"),
    ("0bsd", "0bsd", r"zero[ -]clause bsd|bsd zero clause", r"opensource\.org/licenses?/0bsd", "bsd 0bsd"),
    ("isc", "isc", r"isc", r"opensource\.org/licenses?/isc", "isc"),
    ("mpl-1.1", "mpl-1.1", r"mozilla public licen[cs]e,? (?:version |v\.? ?)1\.1", r"mozilla\.org/mpl/1\.1", "mozilla mpl"),
    ("mpl-2", "mpl-2.0", r"mozilla public licen[cs]e,? (?:version |v\.? ?)2(?:\.0)?", r"mozilla\.org/mpl/2\.0", "mozilla mpl"),
    ("epl-1", "epl-1.0", r"eclipse public licen[cs]e,?(?: -)? (?:version |v ?)1\.0", r"eclipse\.org/legal/epl-v10", "eclipse epl"),
    ("epl-2", "epl-2.0", r"eclipse public licen[cs]e,?(?: -)? (?:version |v ?)2\.0", r"eclipse\.org/legal/epl-2\.0", "eclipse epl"),
    ("cddl-1", "cddl-1.0", r"common development and distribution licen[cs]e", r"opensource\.org/licenses?/cddl", "common cddl"),
    ("cpl-1", "cpl-1.0", r"common public licen[cs]e", r"opensource\.org/licenses?/cpl", "common cpl"),
    ("eupl", "eupl-1.2", r"european union public licen[cs]e", r"joinup\.ec\.europa\.eu/[^\s]*eupl", "european eupl"),
    ("artistic-2", "artistic-2.0", r"artistic licen[cs]e,? (?:version )?2(?:\.0)?", r"opensource\.org/licenses?/artistic-2\.0", "artistic"),
    ("artistic-1", "artistic-1.0", r"artistic licen[cs]e,? (?:version )?1\.0", r"opensource\.org/licenses?/artistic-1\.0", "artistic"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", r"opensource\.org/licenses?/zlib", "zlib"),
    ("boost-1", "bsl-1.0", r"boost software licen[cs]e", r"boost\.org/license_1_0", "boost bsl"),
    ("unlicense", "unlicense", r"the unlicen[cs]e", r"unlicense\.org", "unlicen"),
    ("wtfpl", "wtfpl", r"do what the fuck you want to public licen[cs]e", r"wtfpl\.net", "fuck wtfpl"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql\.org/about/licen[cs]e", "postgresql"),
    ("python-2", "psf-2.0", r"python software foundation licen[cs]e", r"python\.org/psf/license", "python psf"),
    ("ofl", "ofl-1.1", r"sil open font licen[cs]e", r"scripts\.sil\.org/ofl", "sil ofl"),
    ("ms-pl", "ms-pl", r"microsoft public licen[cs]e", r"opensource\.org/licenses?/ms-pl", "microsoft ms"),
    ("osl-3", "osl-3.0", r"open software licen[cs]e", r"opensource\.org/licenses?/osl-3\.0", "open osl"),
    ("sspl", "sspl-1.0", r"server side public licen[cs]e", r"mongodb\.com/licensing/server-side-public-license", "server sspl"),
    ("bsl-1.1", "busl-1.1", r"business source licen[cs]e", r"mariadb\.com/bsl", "business busl mariadb"),
    ("odbl", "odbl-1.0", r"open database licen[cs]e", r"opendatacommons\.org/licenses/odbl", "open odbl"),
    ("pddl", "pddl-1.0", r"public domain dedication and licen[cs]e", r"opendatacommons\.org/licenses/pddl", "public pddl"),
    ("cc0", "cc0-1.0", r"cc0|creative commons zero", r"creativecommons\.org/publicdomain/zero", "cc0 creative"),
    ("cc-by", "cc-by-4.0", r"cc[ -]by(?![ -](?:sa|nc|nd))|creative commons attribution(?![ -](?:share|non|no))", r"creativecommons\.org/licenses/by/", "cc creative"),
    ("cc-by-sa", "cc-by-sa-4.0", r"cc[ -]by[ -]sa|creative commons attribution[ -]share ?-?alike", r"creativecommons\.org/licenses/by-sa/", "cc creative"),
    ("cc-by-nd", "cc-by-nd-4.0", r"cc[ -]by[ -]nd|creative commons attribution[ -]no ?-?deriv\w*", r"creativecommons\.org/licenses/by-nd/", "cc creative"),
    ("cc-by-nc", "cc-by-nc-4.0", r"cc[ -]by[ -]nc(?![ -](?:sa|nd))|creative commons attribution[ -]non ?-?commercial(?![ -](?:share|no))", r"creativecommons\.org/licenses/by-nc/", "cc creative"),
    ("cc-by-nc-sa", "cc-by-nc-sa-4.0", r"cc[ -]by[ -]nc[ -]sa|creative commons attribution[ -]non ?-?commercial[ -]share ?-?alike", r"creativecommons\.org/licenses/by-nc-sa/", "cc creative"),
    ("cc-by-nc-nd", "cc-by-nc-nd-4.0", r"cc[ -]by[ -]nc[ -]nd|creative commons attribution[ -]non ?-?commercial[ -]no ?-?deriv\w*", r"creativecommons\.org/licenses/by-nc-nd/", "cc creative"),
)

#: (form, priority, confidence, keywords): how licences are named; {n} the name, {s} the SPDX id, {u} the address. Every match
#: of a form holds one of its keywords.
FORMS = (
    (r"spdx-license-identifier:\s*{s}(?:-only|-or-later)?(?![\w.-])", 5, 1.0, ("spdx-license-identifier",)),
    (r"https?://(?:www\.)?{u}[^\s]*", 4, 0.95, ("http",)),
    (r"(?:licen[cs]ed|released|distributed|available|published|provided)(?: to you)? under (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?(?:{n})(?:[ -]licen[cs]e)?(?:,? (?:version|v\.?) ?\d(?:\.\d)?| \d\.\d)?", 3, 0.9, ("under",)),
    (r"licen[cs]e\s*[:=]\s*[\"']?(?:{n}|{s})(?![\w.])", 3, 0.85, ("license", "licence")),
    (r"(?:subject to|governed by|covered by|terms of) (?:the )?(?:terms of )?(?:the )?(?:{n})(?:[ -]licen[cs]e)?", 2, 0.8, ("subject", "governed", "covered", "terms")),
    (r"licen[cs]ed under (?:[\w.+/-]+ ){1,8}?(?:or|and|and/or) (?:the )?(?:{n}|{s})(?![\w]|\.\d)", 2, 0.8, ("licen",)),
    (r"(?:the )?(?:{n})[ -]licen[cs]e", 1, 0.7, ("licen",)),
)
#: The last form for names that have the word licence themselves.
OWN_WORD = r"(?:the )?(?:{n})(?:[ -]licen[cs]e|(?![\w]|\.\d))"


def _said(sentence: str) -> str:
    """A regex of the sentence's words with anything but words between them."""
    return r"\W+".join(sentence.split())


_MIT = _said("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files")
_BSD = _said("redistribution and use in source and binary forms")
_ISC = _said("permission to use copy modify and(?:/or|\\W+or)? distribute this software for any purpose with or without fee is hereby granted")
_GNU = (
    ("gpl-1", "general", "1(?:\\.0)?"),
    ("gpl-2", "general", "2(?:\\.0)?"),
    ("gpl-3", "general", "3(?:\\.0)?"),
    ("lgpl-2", "(?:library|lesser)\\W+general", "2(?:\\.0)?"),
    ("lgpl-2.1", "(?:library|lesser)\\W+general", "2\\.1"),
    ("lgpl-3", "(?:library|lesser)\\W+general", "3(?:\\.0)?"),
    ("agpl-3", "affero\\W+general", "3(?:\\.0)?"),
)

#: (label, regex, priority, confidence, keyword): texts and standard notices. Where a text goes on
#: from another's, its detection holds the other's and comes first.
TEXTS = (
    ("mit", _said("permission is hereby granted free of charge") + r"(?!\W+to\W+any\W+person\W+or\W+organi[sz]ation)", 1, 0.6, "hereby"),
    ("mit", _MIT + r"[\s\S]{0,600}?" + _said("subject to the following conditions"), 4, 0.95, "hereby"),
    ("mit-0", _MIT + r"(?:(?!\bsubject\b)[\s\S]){0,500}?" + _said("whom the software is furnished to do so") + r"(?!\W+subject)", 4, 0.95, "hereby"),
    ("boost-1", _said("permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this license"), 4, 0.95, "hereby"),
    ("bsd-4-clause", _BSD + r"[\s\S]{0,1500}?" + _said("all advertising materials mentioning features or use of this software") + r"(?:[\s\S]{0,900}?" + _said("endorse or promote") + ")?", 6, 0.95, "redistribution"),
    ("bsd-3-clause", _BSD + r"[\s\S]{0,1500}?" + _said("may(?:\\W+not)? be used to endorse or promote"), 5, 0.95, "redistribution"),
    ("bsd-2-clause", _BSD, 4, 0.85, "redistribution"),
    ("isc", _ISC + r"\W+provided", 4, 0.95, "hereby"),
    ("0bsd", _ISC + r"(?!\W+provided)", 4, 0.95, "hereby"),
    ("postgresql", _said("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"), 4, 0.95, "hereby"),
    ("zlib", _said("this software is provided as is without any express or implied warranty in no event will the authors be held liable"), 4, 0.95, "liable"),
    ("unlicense", _said("this is free and unencumbered software released into the public domain"), 4, 0.95, "unencumbered"),
    ("wtfpl", _said("you just do what the fuck you want to"), 4, 0.95, "fuck"),
    ("cc0", _said("the person who associated a work with this deed has dedicated the work to the public domain"), 4, 0.95, "deed"),
    ("mpl-2", _said("this source code form is subject to the terms of the mozilla public license v 2"), 4, 0.95, "mozilla"),
    ("mpl-1.1", _said("the contents of this file are subject to the mozilla public license version 1") + r"\W1\b", 4, 0.95, "mozilla"),
    ("apache-2", _said("you may not use this file except in compliance with the license") + r"[\s\S]{0,200}?apache\.org/licenses/license-2\.0", 4, 0.95, "apache"),
    ("apache-2", _said("terms and conditions for use reproduction and distribution") + r"[\s\S]{0,400}?" + _said("shall mean the terms and conditions for use reproduction and distribution"), 4, 0.9, "reproduction"),
    ("epl-2", _said("this program and the accompanying materials are made available under the terms of the eclipse public license") + r"\W+(?:v\W*|version\W+)?2", 4, 0.95, "eclipse"),
    ("epl-1", _said("this program and the accompanying materials are made available under the terms of the eclipse public license") + r"\W+(?:v\W*|version\W+)?1", 4, 0.95, "eclipse"),
    ("cddl-1", _said("the contents of this file are subject to the terms of the common development and distribution license"), 4, 0.95, "common"),
    ("ofl", _said("this font software is licensed under the sil open font license"), 4, 0.95, "font"),
    ("ofl", _said("permission is hereby granted free of charge to any person obtaining a copy of the font software"), 4, 0.95, "font"),
    ("eupl", _said("licensed under the eupl"), 3, 0.9, "eupl"),
    ("artistic-2", _said("everyone is permitted to copy and distribute verbatim copies of this license document") + r"[\s\S]{0,400}?" + _said("artistic license"), 3, 0.8, "artistic"),
    ("gpl-3", _said("the gnu general public license is a free copyleft license for software and other kinds of works"), 4, 0.95, "copyleft"),
    ("gpl-2", _said("the licenses for most software are designed to take away your freedom to share and change it"), 4, 0.9, "freedom"),
    ("agpl-3", _said("the gnu affero general public license is a free copyleft license for software and other kinds of works"), 4, 0.95, "copyleft"),
    ("cc-by", _said("creative commons attribution 4 0 international public license"), 4, 0.95, "creative"),
    ("cc-by-sa", _said("creative commons attribution sharealike 4 0 international public license"), 4, 0.95, "creative"),
    ("cc-by-nc", _said("creative commons attribution noncommercial 4 0 international public license"), 4, 0.95, "creative"),
    ("cc-by-nd", _said("creative commons attribution noderivatives 4 0 international public license"), 4, 0.95, "creative"),
    ("cc-by-nc-sa", _said("creative commons attribution noncommercial sharealike 4 0 international public license"), 4, 0.95, "creative"),
    ("cc-by-nc-nd", _said("creative commons attribution noncommercial noderivatives 4 0 international public license"), 4, 0.95, "creative"),
    ("cc0", _said("to the extent possible under law") + r"[\s\S]{0,200}?" + _said("waived all copyright and related or neighboring rights"), 4, 0.95, "waived"),
    ("zlib", _said("altered source versions must be plainly marked as such and must not be misrepresented as being the original software"), 4, 0.9, "misrepresented"),
    ("ms-pl", _said("this license governs use of the accompanying software if you use the software you accept this license"), 4, 0.9, "governs"),
    ("python-2", _said("this license agreement is between the python software foundation"), 4, 0.95, "python"),
    ("bsl-1.1", _said("the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"), 4, 0.95, "hereby"),
    ("sspl", _said("offering the program as a service"), 2, 0.6, "service"),
    *((label, _said(f"gnu {name} public licen[cs]e") + r"(?:\W+as\W+published\W+by\W+the\W+free\W+software\W+foundation)?(?:\W+either)?\W+(?:version\W+|v\W*)" + number + r"(?![\w]|\.\d)", 1, 0.9, "gnu") for label, name, number in _GNU),
    *((label, r"version\W+" + number + r"\W+(?:only\W+)?" + _said(f"of the gnu {name} public licen[cs]e"), 1, 0.9, "gnu") for label, name, number in _GNU),
)


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    regex: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    #: Words of the licence, one of which begins a word of every match; none: the keywords are enough.
    words: tuple[str, ...] = ()


def _alternatives(regex: str) -> list[str]:
    """The parts of a regex between the bars of its outer level and of a group that it begins with."""
    if regex.startswith("(?:"):
        end = regex.index(")")
        if "|" in regex[:end]:
            return regex[3:end].split("|")
    out, depth = [""], 0
    for c in regex:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _any_space(regex: str) -> str:
    """The regex with any white space for a space."""
    return regex.replace("[ -]", r"[\s-]").replace(" ?", r"\s*").replace(" ", r"\s+")


def default_rules() -> tuple[Rule, ...]:
    """Every licence in every form, and every text, in order."""
    made = []
    for form, priority, confidence, keys in FORMS:
        for label, spdx, name, address, words_ in LICENCES:
            own = form == FORMS[-1][0] and all(re.search("licen", x) for x in _alternatives(name))
            regex = (OWN_WORD if own else form).replace("{n}", name).replace("{s}", re.escape(spdx)).replace("{u}", address)
            made.append(Rule(len(made), label, r"(?<![\w])" + _any_space(regex), priority, confidence, keys, tuple(words_.split())))
    for label, regex, priority, confidence, key in TEXTS:
        made.append(Rule(len(made), label, r"(?<![\w])" + regex, priority, confidence, (key,)))
    return tuple(made)


@cache
def _compiled(rules: tuple[Rule, ...]):
    """The automata of all keywords and of all words; the rules of each of them; those without words; the regexes."""
    import ahocorasick

    by_key: dict[str, set[int]] = {}
    by_word: dict[str, set[int]] = {}
    for k, r in enumerate(rules):
        for key in r.keywords:
            by_key.setdefault(key, set()).add(k)
        for word in r.words:
            by_word.setdefault(word, set()).add(k)
    automata = []
    for keys in (by_key, by_word):
        automata.append(ahocorasick.Automaton())
        for key in keys:
            automata[-1].add_word(key, key)
        if keys:
            automata[-1].make_automaton()
    return automata, by_key, by_word, frozenset(k for k, r in enumerate(rules) if not r.words), [re.compile(r.regex) for r in rules]


def tried(text: str, compiled: tuple) -> list[int]:
    """The rules that can match: one of their keywords is in the text, and one of their words begins a word of it."""
    (auto, auto_words), by_key, by_word, without, _ = compiled
    keys = {key for _, key in auto.iter(text)}
    if not keys:
        return []
    begun = set()
    for end, word in auto_words.iter(text) if by_word else ():
        if word not in begun:
            at = end - len(word)
            if at < 0 or not (text[at].isalnum() or text[at] == "_"):
                begun.add(word)
    return sorted(set().union(*(by_key[k] for k in keys)) & without.union(*(by_word[k] for k in begun)))


def resolve(found: list[tuple[int, int, int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, rule) of the detections (-priority, -length, start, order, end, rule) that lie within none taken before.

    Of the detections taken those that lie within another need not be looked at again: what is left rises in start and
    end together, so that one binary search decides.
    """
    kept, starts, ends = [], [], []
    for _, _, start, _, end, k in sorted(found):
        at = bisect.bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, k))
        lo = bisect.bisect_left(starts, start)
        hi = max(lo, bisect.bisect_right(ends, end))
        starts[lo:hi], ends[lo:hi] = [start], [end]
    return sorted(kept)


def detect(text: str, rules: tuple[Rule, ...], compiled: tuple | None = None) -> list[tuple[int, int, str, float]]:
    """(start, end, label, confidence) of the detections that stand, by start; ``text`` is in lower case. ``compiled``: what
    ``_compiled`` gives for the rules, to be asked for once and not for every text."""
    compiled = compiled or _compiled(rules)
    regexes = compiled[-1]
    found = [(-rules[k].priority, m.start() - m.end(), m.start(), rules[k].order, m.end(), k) for k in tried(text, compiled) for m in regexes[k].finditer(text)]
    return [(start, end, rules[k].label, rules[k].confidence) for start, end, k in resolve(found)]


def _scan(rules: tuple[Rule, ...], base: tuple[tuple[str, str], ...]):
    phrases = [(np.array([hash_word(w) for w in p.split()], np.uint64), label) for p, label in base]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _compiled(rules)
        for batch in batches:
            n = batch.num_rows
            n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
            first, last, names, full, score, found = ([None] * n for _ in range(6))
            texts = batch.column(1)
            for lo, hi, buf, offs in chunks(texts):
                w = words(buf, offs, ALNUM)
                lower = LOWER[buf]
                n_words[lo:hi] = np.diff(w.first)
                hits: dict[int, list[tuple[int, str]]] = {}
                for p, label in phrases:
                    m = len(w.hash) - len(p) + 1
                    if m <= 0:
                        continue
                    ok = np.flatnonzero(w.hash[:m] == p[0])
                    for j in range(1, len(p)):
                        ok = ok[w.hash[ok + j] == p[j]]
                    ok = ok[w.row[ok] == w.row[ok + len(p) - 1]]
                    for x in ok:
                        hits.setdefault(int(w.row[x]), []).append((int(x - w.first[w.row[x]]), label))
                for i in range(lo, hi):
                    own = hits.get(i - lo, ())
                    labels = {x for _, x in own}
                    n_base[i] = len(own)
                    if own:
                        first[i], last[i] = min(own)[0], max(own)[0]
                    names[i] = ",".join(sorted(labels))
                    got = detect(lower[offs[i - lo] : offs[i - lo + 1]].tobytes().decode(), rules, compiled)
                    found[i] = [{"start": a, "end": b, "label": x, "confidence": c} for a, b, x, c in got]
                    full[i] = ",".join(sorted(labels | {x for _, _, x, _ in got}))
                    score[i] = max([c for *_, c in got] + [0.9] * bool(own) + [0.0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(names, pa.string()), pa.array(full, pa.string()), pa.array(score, pa.float64()), pa.array(found, spans)],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )

    return of


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] | None = None, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """Per document its words, base phrases, labels, score (the surest detection's) and detections (characters)."""
    out = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start: int, end: int, label: string, confidence: double>>"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(rules or default_rules(), base), out)
