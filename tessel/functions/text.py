"""String expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters by what they become, in the order in which they are replaced.
CONTROLS = "\u0001\u0002\u0003\u0004\u0005\u0006\u0007\u0008\u000e\u000f\u0011\u0012\u0013\u0014\u0015\u0016\u0017\u0018\u0019\u001a\u001b"
SPACES = "\u000b\u000c\u0085"
HYPHENS = "‐‑⁃‒–—―−－⁻"
SOFT_HYPHEN = "­"
DOUBLE_QUOTES = "“”„‟"
SINGLE_QUOTES = "‘’‚‛՚Ꞌꞌ＇`´′‵"
PRIMES = (("″", "''"), ("‶", "''"), ("‴", "'''"), ("‷", "'''"), ("⁗", "''''"))
SLASHES = "⁄∕"
ZERO_WIDTH = "​‌‍﻿"
SMART_DOUBLE, SMART_SINGLE = "“”„‟", "‘’‚‛"

# Openings of captions that are no captions.
INVALID_OPENINGS = ("uncertain", "Generate Captions", "Generate Text_new", "Generate Polar Questions", "Answer Questions via Image Comparison", "Local Edits", "Decompose Intents")
MAX_CAPTION = 300
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "bmp", "gif", "webp")

# Fixed value: the pattern of an address.
URL = r"(?i)^(?:http|ftp)s?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+(?:[A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"


def normalize(text: Column) -> Column:
    """One form for controls, spaces, hyphens, quotes, primes, ellipses and slashes; tildes stay.

    One pass of ``translate`` does all replacements of one character by one or none.
    """
    one = SPACES + HYPHENS + DOUBLE_QUOTES + SINGLE_QUOTES + SLASHES
    to = " " * len(SPACES) + "-" * len(HYPHENS) + '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES) + "/" * len(SLASHES)
    out = F.translate(text, one + CONTROLS + SOFT_HYPHEN, to)
    for a, b in PRIMES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(F.replace(out, F.lit("…"), F.lit("...")), F.lit(" . . . "), F.lit(" ... "))


def tokens(text: Column) -> Column:
    """The text split at every character that is not a letter, digit or underscore of ASCII; empty tokens stay."""
    return F.split(text, "[^A-Za-z_0-9]", -1)


def word_ngrams(text: Column, n: int = 5) -> Column:
    """The distinct n-grams of ``tokens``, joined by spaces; none if there are fewer tokens."""

    def grams(t: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))
        return F.when(F.size(t) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    # the tokens go through a variable of a function, or they would be split again for every n-gram
    return F.transform(F.array(tokens(text)), grams)[0]


def sha1_hash32(text: Column) -> Column:
    """The first four bytes of SHA-1, the least significant first."""
    h = F.sha1(text.cast("binary"))
    swapped = F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("long")


def small_hash(items: Column, length: int = 8) -> Column:
    """A short digest of a set of strings, whatever their order."""
    return F.substring(F.md5(F.array_join(F.array_sort(items), "").cast("binary")), 1, length)


def preclean(text: Column, blanks: str | None = None) -> Column:
    """Without marks of no width and fenced code, with plain quotes, trimmed: of white space, or of the characters ``blanks``."""
    out = F.regexp_replace(F.translate(text, ZERO_WIDTH, ""), r"```[\s\S]*?```", "")
    out = F.translate(out, SMART_DOUBLE + SMART_SINGLE, '"' * len(SMART_DOUBLE) + "'" * len(SMART_SINGLE))
    return F.regexp_replace(out, r"^\s+|\s+$", "") if blanks is None else F.trim(out, F.lit(blanks))


def is_valid_caption(text: Column, strict: bool = False, longest: int = MAX_CAPTION) -> Column:
    """Whether a caption is not blank, not too long and does not open like an answer of another kind.

    Openings are compared with the lower-cased caption as they are written, so that those with capitals match nothing;
    ``strict`` lower-cases both.
    """
    low = F.lower(text)
    bad = F.lit(False)
    for p in INVALID_OPENINGS:
        bad |= low.startswith(p.lower() if strict else p)
    return F.coalesce((F.length(F.trim(text)) > 0) & (F.length(text) <= longest) & ~bad, F.lit(False))


def truncated(text: Column, most: int = 1000) -> Column:
    return F.substring(text, 1, most)


def is_url(text: Column) -> Column:
    return F.coalesce(text.rlike(URL), F.lit(False))


def is_image_file(path: Column, endings: tuple[str, ...] = IMAGE_ENDINGS) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*endings), F.lit(False))


def full_path(path: Column, base: str) -> Column:
    """Trimmed and without a leading ./; an absolute path stays, another one is put under ``base``. Doubled slashes and
    /./ are taken out; a step up (..) is taken with the name before it, as long as there is one."""
    p = F.regexp_replace(F.trim(path), r"^(\./)+", "")
    whole = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), p))
    parts = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def option_lines(question: Column, options: Column, answer: Column) -> Column:
    """(question, options, answer, answer_idx): options lettered from (A); an answer that is none has no letter."""
    lettered = F.transform(options, lambda c, i: F.concat(F.lit("("), F.char(i + 65), F.lit(") "), c))
    # of equal options the last counts
    last = F.size(options) - F.array_position(F.reverse(options), answer).cast("int")
    idx = F.when(F.array_contains(options, answer), last)
    text = F.concat(question, F.lit("\nOptions:\n"), F.array_join(lettered, "\n"))
    return F.struct(text.alias("question"), lettered.alias("options"), F.concat(F.lit("("), F.char(idx + 65), F.lit(") "), answer).alias("answer"), idx.alias("answer_idx"))


def document_text(title: Column, text: Column, sep: str = " ") -> Column:
    return F.trim(F.concat_ws(sep, title, text))


def str2bool(text: Column) -> Column:
    """yes/true/t/y/1 and no/false/f/n/0 in any case; another text raises."""
    low = F.lower(text)
    return F.when(low.isin("yes", "true", "t", "y", "1"), F.lit(True)).when(low.isin("no", "false", "f", "n", "0"), F.lit(False)).when(text.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))


def clock(seconds: Column) -> Column:
    """mm:ss"""
    s = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60)))


def natural_key(path: Column, width: int = 20) -> Column:
    """A key under which runs of digits sort as numbers: each is padded with zeros."""
    parts = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, width, "0")).otherwise(F.lower(x))), "")


def checkpoint_step(path: Column) -> Column:
    """The number after ``checkpoint-``, or null."""
    return F.regexp_extract(path, r"checkpoint-(\d+)$", 1).try_cast("long")


def model_family(path: Column) -> Column:
    """Family and size that a model's path names."""
    low = F.lower(path)
    family = F.when(low.rlike("qwen2[._-]?5"), "qwen2_5_vl").when(low.rlike("qwen2"), "qwen2_vl").when(low.rlike("llava"), "llava").otherwise("unknown")
    return F.struct(family.alias("family"), F.nullif(F.regexp_extract(low, r"(\d+(?:\.\d+)?b)(?![a-z0-9])", 1), F.lit("")).alias("size"))


def prompt(instruction: Column, text: Column, family: Column, image: bool = False, video: bool = False) -> Column:
    """Instruction and text with the marks that a family of models puts for images and videos."""
    tag = lambda q, other: F.when(family.isin("qwen2_vl", "qwen2_5_vl"), F.lit(q)).otherwise(F.lit(other))
    marks = []
    if image:
        marks.append(tag("<|vision_start|><|image_pad|><|vision_end|>", "<image>"))
    if video:
        marks.append(tag("<|vision_start|><|video_pad|><|vision_end|>", "<video>"))
    return F.trim(F.concat_ws(" ", *marks, instruction, text))


def pad_tokens(ids: Column, most: Column, pad: int = 0, left: bool = False) -> Column:
    """(ids, mask): token ids filled to ``most``, and 1 where a token is."""
    gap = most - F.size(ids)
    fill, ones, zeros = F.array_repeat(F.lit(pad), gap), F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap)
    return F.struct((F.concat(fill, ids) if left else F.concat(ids, fill)).alias("ids"), (F.concat(zeros, ones) if left else F.concat(ones, zeros)).alias("mask"))


def layer_ranges(spec: Column, layers: int) -> Column:
    """`[a,b,v]...` as an array of ``layers`` values: v from a to b, not included; later ranges win; else 0."""
    found = F.regexp_extract_all(spec, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    triple = F.transform(found, lambda x: F.transform(F.split(x, r"\s*,\s*"), lambda y: F.trim(y).cast("double")))
    start = F.array_repeat(F.lit(0.0), layers)
    return F.aggregate(triple, start, lambda acc, t: F.transform(acc, lambda v, i: F.when((i >= t[0]) & (i < t[1]), t[2]).otherwise(v)))


def text_new(text: Column) -> Column:
    """The value of text_new in a model's answer: as JSON, fenced JSON, a fragment, or a bare assignment; ' ' if there is
    none, null for an empty answer."""
    value = lambda pattern, group=1: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))
    fenced = F.regexp_extract(text, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    steps = [
        F.get_json_object(F.trim(text), "$.text_new"),
        F.get_json_object(fenced, "$.text_new"),
        value(r'(?s)\{[^{}]*"text_new"\s*:\s*"([^"]*)"[^{}]*\}'),
        value(r'"text_new"\s*:\s*"([^"]*)"'),
        value(r'text_new\s*[=:]\s*"([^"]*)"'),
        value(r'"Text_new"\s*[:=]\s*"([^"]*)"'),
    ]
    return F.when(F.length(text) > 0, F.coalesce(*steps, F.lit(" ")))
