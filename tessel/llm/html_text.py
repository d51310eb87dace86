"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks of the DOM.

A page is read once into its leaf blocks: stretches of text between tags that break a line, each with the tags and the
class, id and role words of its ancestors. Features of a block are its ancestors, its links, length and punctuation, and
whether the page has a main element elsewhere. Two labels, content or not, chained over the page; weights by gradient on
the likelihood of labelled pages, with forward-backward sums; decoding by Viterbi.

``labelled_pages`` makes the pages that the registered query is trained on: layouts drawn from the elements and class
words that sites use, with the label of every block known. ``fit`` takes any pages labelled in the same way.

Edge cases. A null or empty page gives an empty text. Markup that is cut off or not closed is read as far as it goes;
an unfinished tag at the end is dropped. The text of a list to choose from is left out, up to its end or the next block.
A page of any size and depth is read in time that grows with its length. Ties: of labellings as likely Viterbi takes
"not content". Every row has its own result, also if rows are equal; an empty table gives an empty one. Other columns are
ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by what they do.
RAW = frozenset("script style noscript template iframe textarea title".split())
CHOICE = frozenset("select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label data ruby rt rp img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BREAKS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")


# Elements by which a page is divided.
SECTIONS = frozenset("nav header footer aside form article main section".split())
#: Elements inside a line's text: what they hold is part of the block, but their names are no ancestors.
INNER = INLINE | frozenset("math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder mtable mtr mtd semantics annotation svg g text tspan path rect circle line defs desc object canvas select option optgroup datalist".split())


@dataclass
class Block:
    text: str
    tags: frozenset[str]
    leaf: str
    section: str
    marks: frozenset[str]
    linked: int


@dataclass(frozen=True)
class _Open:
    """An open element, with what holds for all that is in it."""

    tag: str
    tags: frozenset[str]
    leaf: str
    section: str
    marks: frozenset[str]
    link: int


def _marks(attrs: str) -> tuple[str, ...]:
    found = []
    for name, a, b, c in _ATTR.findall(attrs):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            found += _WORD.findall((a or b or c).lower())
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", a or b or c):
            found.append("hidden")
    return tuple(found)


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page, in order, with decoded and trimmed text; blocks without text are left out.

    With ``known``, tags and marks that are not among these are left out of the blocks: a bound for what pages of
    thousands of open elements take.
    """
    out: list[Block] = []
    none: frozenset[str] = frozenset()
    root = _Open("", none, "", "", none, 0)
    stack: list[_Open] = [root]
    opened: Counter = Counter()
    parts: list[str] = []
    linked = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            top = stack[-1]
            out.append(Block(text, top.tags, top.leaf, top.section, top.marks, min(linked, len(text))))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if opened["select"] or opened["datalist"]:
            return
        parts.append(text)
        if stack[-1].link:
            linked += len(text.strip())

    def push(tag: str, attrs: str) -> None:
        top = stack[-1]
        own = [] if tag in ("html", "body") else [m for m in _marks(attrs) if m not in top.marks and (known is None or m in known)]
        inner = tag in INNER
        new = not inner and tag not in top.tags and (known is None or tag in known)
        stack.append(_Open(tag, top.tags | {tag} if new else top.tags, top.leaf if inner else tag, tag if tag in SECTIONS else top.section, top.marks.union(own) if own else top.marks, 4 if tag == "a" else max(0, top.link - 1)))
        opened[tag] += 1

    def close(names: tuple[str, ...], within: tuple[str, ...]) -> None:
        if not any(opened[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                for gone in stack[k:]:
                    opened[gone.tag] -= 1
                del stack[k:]
                return
            if stack[k].tag in within:
                return

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        k = 2 if m[2] else 6
        if not m[k]:
            continue
        tag, ends = m[k].lower(), m[k + 2] == ""
        if ends:  # cut off in the tag
            break
        if m[k - 1]:
            if tag not in INNER:
                flush()
            close((tag,), ())
            continue
        if tag in RAW:
            if not m[k + 1].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag not in INNER:
            if tag in BREAKS_P or tag in CLOSES and tag != "option":
                close(tuple(CHOICE), ())  # not closed: a block ends it
            flush()
            if tag in BREAKS_P:
                close(("p",), ("div", "td", "th", "section", "article", "aside", "blockquote", "li", "table", "button"))
            if tag in CLOSES and tag != "p":
                close(CLOSES[tag], ("ul", "ol", "dl", "table"))
        if tag not in VOID and not m[k + 1].endswith("/"):
            push(tag, m[k + 1])
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    has = {tag for b in page for tag in b.tags if tag in ("article", "main")}
    out, seen_title = [], False
    for b in page:
        f = [f"t:{t}" for t in b.tags] + [f"c:{m}" for m in b.marks]
        f.append(f"leaf:{b.leaf}")
        f.append(f"sec:{b.section}")
        f.append("inside" if has & b.tags else "outside" if has else "nowhere")
        size = len(b.text.split())
        f.append(f"n:{min(6, size.bit_length())}")
        share = b.linked / max(1, len(b.text))
        f.append(f"a:{0 if share == 0 else 1 if share < 0.5 else 2}")
        f.append("stop" if b.text[-1] in ".!?:\"”’" else "open")
        if "©" in b.text:
            f.append("copyright")
        seen_title = seen_title or b.leaf == "h1"
        f.append(f"title:{int(seen_title)}")
        out.append(f)
    return out


@dataclass
class Crf:
    index: dict[str, int]
    weights: np.ndarray
    chain: np.ndarray

    def known(self) -> frozenset[str]:
        """The tags and marks that have weights, and those that features are made from."""
        return frozenset(x[2:] for x in self.index if x[:2] in ("t:", "c:")) | SECTIONS

    def scores(self, page: list[Block]) -> np.ndarray:
        return np.array([self.weights[[self.index[x] for x in f if x in self.index]].sum(0) for f in features(page)])

    def decode(self, page: list[Block]) -> list[int]:
        """The most likely labels, by Viterbi."""
        if not page:
            return []
        (a, b), (c, d) = self.chain.tolist()
        rows = self.scores(page).tolist()
        x, y = rows[0]
        back = []
        for u, v in rows[1:]:
            x0, x1, y0, y1 = x + a, y + c, x + b, y + d
            back.append((x1 > x0, y1 > y0))
            x, y = max(x0, x1) + u, max(y0, y1) + v
        label = int(y > x)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = 12, rate: float = 0.5, decay: float = 1e-3) -> Crf:
    """Weights that make the labels of the pages likely, by AdaGrad on one page after the other."""
    index: dict[str, int] = {}
    data = [([[index.setdefault(x, len(index)) for x in f] for f in features(p)], y) for p, y in pages if p]
    w, g2 = np.zeros((len(index), 2)), np.full((len(index), 2), 1e-6)
    chain, c2 = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    for _ in range(epochs):
        for f, y in data:
            n = len(f)
            s = [w[i].sum(0).tolist() for i in f]
            t = chain.tolist()
            fwd, bwd = [s[0]], [[0.0, 0.0]]
            for k in range(1, n):
                p = fwd[-1]
                fwd.append([_log_add(p[0] + t[0][j], p[1] + t[1][j]) + s[k][j] for j in (0, 1)])
            for k in range(n - 1, 0, -1):
                q = bwd[-1]
                bwd.append([_log_add(t[i][0] + s[k][0] + q[0], t[i][1] + s[k][1] + q[1]) for i in (0, 1)])
            bwd.reverse()
            z = _log_add(*fwd[-1])
            gc = np.zeros((2, 2))
            for k in range(n):
                p1 = math.exp(min(0.0, fwd[k][1] + bwd[k][1] - z))
                g = np.array([y[k] - p1, p1 - y[k]])
                if abs(p1 - y[k]) > 1e-4:
                    i = f[k]
                    gi = g + decay * w[i]
                    g2[i] += gi * gi
                    w[i] -= rate * gi / np.sqrt(g2[i]) / len(i) ** 0.5
                if k:
                    for i in (0, 1):
                        for j in (0, 1):
                            gc[i, j] += math.exp(min(0.0, fwd[k - 1][i] + t[i][j] + s[k][j] + bwd[k][j] - z)) - (y[k - 1] == i and y[k] == j)
            c2 += gc * gc
            chain -= 0.5 * rate * gc / np.sqrt(c2)
    return Crf(index, w, chain)


# Class and id words of sites, by what they mark.
_CONTENT = "content post entry story body text article main page blog news single hentry detail prose".split()
_NEUTRAL = "container wrapper row col inner box block section wrap grid layout site module item left right center clearfix".split()
_OTHER = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topbar tabs pagination pager".split(),
    "header": "header masthead banner logo branding top site".split(),
    "footer": "footer bottom copyright legal colophon foot".split(),
    "aside": "sidebar aside widget related recommended popular trending rail secondary".split(),
    "div": "ad ads advert advertisement sponsored promo promotion dfp adsense commercial".split(),
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay disclaimer message warning".split(),
    "form": "form newsletter subscribe signup login search contact register".split(),
    "comments": "comments comment disqus replies reply respond discussion commentlist".split(),
    "share": "share sharing social follow tags meta author byline toolbar".split(),
}


def labelled_pages(n: int = 320, seed: int = 11) -> Iterator[tuple[str, list[str]]]:
    """(page, texts of its content blocks); every block of a page has a text of its own."""
    rng = random.Random(seed)
    serial = 0

    def text(lo: int, hi: int, stop: bool = True) -> str:
        nonlocal serial
        serial += 1
        said = [f"w{serial}"] + ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(lo, hi) - 1)]
        return " ".join(said).capitalize() + ("." if stop else "")

    def named(words: list[str]) -> str:
        chosen = [rng.choice(words)] + ([rng.choice(_NEUTRAL)] if rng.random() < 0.3 else [])
        value = rng.choice("- _").join(chosen)
        return rng.choice([f' class="{value}"', f' id="{value}"', f' class="{value} {rng.choice(_NEUTRAL)}"'])

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{j}">{text(1, 3, False)}</a></li>' for j in range(k)) + "</ul>"

    def paragraphs(k: int) -> str:
        return "".join(f"<p>{text(3, 40)}</p>" for _ in range(k))

    def other(kind: str) -> str:
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.75 else rng.choice(["div", "section", "div", "ul" if kind == "nav" else "div"])
        attr = named(_OTHER[kind]) if tag in ("div", "section", "ul") or rng.random() < 0.4 else ""
        if kind == "comments":
            said = "".join(f"<{t}{named(_OTHER[kind])}><p>{text(2, 40)}</p></{t}>" for t in [rng.choice(["div", "li", "article"])] * rng.randint(1, 4))
            inner = (f"<h3>{text(1, 3, False)}</h3>" if rng.random() < 0.7 else "") + said
        elif kind == "form":
            inner = rng.choice([f"<label>{text(1, 4, False)}</label><input name=q>", f"<p>{text(3, 25)}</p><input><button>{text(1, 2, False)}</button>"])
        elif kind == "nav" or rng.random() < 0.35:
            inner = links(rng.randint(2, 7))
            inner = inner[4:-5] if tag == "ul" else inner
        elif kind == "footer":
            inner = rng.choice([f"&copy; {text(1, 12)}", f"<p>&copy; {text(2, 15)}</p>" + links(2), f"<p>{text(3, 25)}</p>"])
        else:
            inner = rng.choice([text(2, 30), f"<p>{text(2, 35)}</p>", f"<h3>{text(1, 4, False)}</h3>" + paragraphs(rng.randint(1, 3)), f'<p><a href="#">{text(2, 12)}</a></p>'])
        return f"<{tag}{attr}>{inner}</{tag}>"

    for _ in range(n):
        content: list[str] = []

        def own(s: str) -> str:
            content.append(s)
            return s

        body = [f"<h1>{own(text(2, 14, rng.random() < 0.4))}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 10)):
            body.append(
                rng.choice(
                    [
                        lambda: f"<p>{own(text(1, 60))}</p>",
                        lambda: f"<p>{own(text(3, 60))}</p>",
                        lambda: f"<p>{own(text(3, 60))}",
                        lambda: f"<p><b>{own(text(2, 20))}<br><p>{own(text(2, 40))}</p>",
                        lambda: f"<h2>{own(text(1, 8, False))}</h2><p>{own(text(3, 50))}</p>",
                        lambda: "<ul>" + "".join(f"<li>{own(text(1, 15, rng.random() < 0.5))}</li>" for _ in range(rng.randint(2, 4))) + "</ul>",
                        lambda: f"<blockquote>{own(text(4, 30))}</blockquote>",
                        lambda: f"<div>{own(text(8, 60))}</div>",
                        lambda: f"<table><tr><td>{own(text(1, 4, False))}</td><td>{own(text(1, 6, False))}</td></tr></table>",
                        lambda: f"<figure><img src=x><figcaption>{own(text(3, 12))}</figcaption></figure>",
                        lambda: f"<pre>{own(text(3, 20, False))}</pre>",
                        lambda: other(rng.choice(["div", "aside", "share", "form", "notice"])) if rng.random() < 0.5 else f"<p>{own(text(3, 40))}</p>",
                    ]
                )()
            )
        inner = "".join(body)
        if rng.random() < 0.25:
            inner += other(rng.choice(["comments", "share", "aside"]))
        tag = rng.choice(["article", "article", "main", "div", "div", "section", ""])
        if tag in ("div", "section"):
            inner = f"<{tag}{named(_CONTENT)}>{inner}</{tag}>"
        elif tag:
            inner = f"<{tag}{named(_CONTENT + _NEUTRAL) if rng.random() < 0.4 else ''}>{inner}</{tag}>"
        if tag == "article" and rng.random() < 0.3:
            inner = f"<main>{inner}</main>"
        before = [other(rng.choice(["nav", "header", "notice", "div", "form", "nav"])) for _ in range(rng.randint(0, 4))]
        after = [other(rng.choice(["footer", "comments", "aside", "share", "div", "form", "notice"])) for _ in range(rng.randint(0, 4))]
        whole = "".join(before) + inner + "".join(after)
        if rng.random() < 0.4:
            whole = f"<div{named(_NEUTRAL)}>{whole}</div>"
        yield f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{text(2, 8, False)}</title></head><body{named(_NEUTRAL + _CONTENT) if rng.random() < 0.3 else ''}>{whole}</body></html>", content


def label(page: str, content: list[str]) -> tuple[list[Block], list[int]]:
    """A page's blocks and which of them are content."""
    found, wanted = blocks(page), set(content)
    return found, [int(b.text in wanted) for b in found]


@cache
def default_model() -> Crf:
    return fit([label(*x) for x in labelled_pages()])


def _extract(model: Crf):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known()
        for batch in batches:
            texts, kept = [], []
            for page in batch.column(2):
                found = blocks(page.as_py() or "", known)
                labels = model.decode(found)
                texts.append(" ".join(b.text for b, y in zip(found, labels, strict=True) if y))
                kept.append(sum(labels))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.int64())], names=["id", "url", "text", "n_chars", "n_blocks"])

    return of


def extract(pages: DataFrame, model: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_blocks) per page."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract(model or default_model()), "id long, url string, text string, n_chars long, n_blocks long")
