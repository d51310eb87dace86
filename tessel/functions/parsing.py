"""Parsers for what models answer, as Arrow-batched functions: the grammars have look-back that SQL lacks."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions.text import preclean

_WH = re.compile(r"^\s*(what|which|who|whom|whose|where|when|why|how)\b", re.I)
_POLAR = re.compile(r"^\s*(is|are|was|were|do|does|did|has|have|had|can|could|will|would|should)\b", re.I)
# The titles of the stages of an answer, in order.
STAGES = ("Generate Captions", "Decompose Intents", "Generate Polar Questions", "Answer Questions via Image Comparison", "Local Edits", "Generate Text_new")


def decomposition(text: str | None) -> list[str]:
    """The parts that an answer names: from the outermost JSON object, else its lines, else the whole."""
    if not text:
        return []
    lo, hi = text.find("{"), text.rfind("}")
    if 0 <= lo < hi:
        try:
            parts = json.loads(text[lo : hi + 1]).get("sub_modifications")
            if parts is not None:
                return [str(x) for x in parts]
        except (ValueError, AttributeError):
            return [text]
    lines = [x.strip() for x in text.split("\n")]
    cleaned = [x.strip().lstrip('" ').rstrip('", ') for x in lines if x and not x.startswith(("{", "}", '"sub_modifications"'))]
    return [x for x in cleaned if x] or [text]


def key_values(line: str) -> dict[str, str | list[str]]:
    """`I1 | k="v" | list=[a, b]` as a mapping; the id is that of the first field."""
    fields = [x.strip() for x in line.split("|")]
    out: dict[str, str | list[str]] = {}
    if m := re.match(r"i\s*(\d+)", fields[0], re.I):
        out["id"] = f"I{m[1]}"
        fields = fields[1:]
    elif "=" in fields[0] and re.match(r"\w+\s*=", fields[0]):
        k, v = fields[0].split("=", 1)
        out[k.strip()] = v.strip()
        fields = fields[1:]
    else:
        fields = fields[1:]
    for f in fields:
        k, eq, v = (x.strip() for x in f.partition("="))
        if not eq:
            continue
        if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'":
            v = v[1:-1]
        out[k] = _listed(v) if v.startswith("[") and v.endswith("]") else v
    return out


def _listed(v: str) -> list[str]:
    try:
        got = ast.literal_eval(v)
        if isinstance(got, list):
            return [str(x).strip() for x in got]
    except (ValueError, SyntaxError):
        pass
    return [x.strip() for x in v[1:-1].split(",") if x.strip()]


def stages(text: str) -> dict[str, str]:
    """The text under each stage's title, up to the next title; stages that are missing are left out."""
    at = []
    for name in STAGES:
        if m := re.search(rf"^[#*\s\d.)]*(?:stage\s*\d+\s*[:.-]?\s*)?{re.escape(name)}\b.*$", text, re.I | re.M):
            at.append((m.start(), m.end(), name))
    at.sort()
    return {name: text[end : at[k + 1][0] if k + 1 < len(at) else len(text)].strip() for k, (_, end, name) in enumerate(at)}


def parse_answer(text: str) -> dict:
    """A staged answer as captions, intents, questions, answers, edits and the new text, with what is wrong with it."""
    found = stages(text)
    rows = {k: [x for x in (key_values(line) for line in v.split("\n") if re.match(r"\s*i\s*\d+", line, re.I)) if "id" in x] for k, v in found.items()}
    captions = dict(re.findall(r"(?im)^\W*(reference|target)\w*\s*(?:caption)?\s*[:=]\s*\"?(.*?)\"?\s*$", found.get(STAGES[0], "")))
    text_new = re.search(r'(?i)text_new\s*[:=]\s*"?(.*?)"?\s*$', found.get(STAGES[5], text), re.M)
    intents, questions, answers, edits = (rows.get(s, []) for s in STAGES[1:5])
    ids = [{x["id"] for x in part} for part in (intents, questions, answers) if part]
    q = [str(x.get("Q", x.get("question", ""))) for x in questions]
    return {
        "reference": captions.get("reference", captions.get("Reference")),
        "target": captions.get("target", captions.get("Target")),
        "n_intents": len(intents),
        "n_questions": len(questions),
        "n_answers": len(answers),
        "n_edits": len(edits),
        "aligned": all(a == ids[0] for a in ids),
        "wh_questions": sum(bool(_WH.match(x)) for x in q),
        "not_polar": sum(not _POLAR.match(x) for x in q),
        "missing": [s for s in STAGES if s not in found],
        "text_new": text_new[1] if text_new else None,
    }


def repair_json(text: str | None) -> str | None:
    """The last object of an answer that can be read as JSON, in canonical form: comments and trailing commas are
    dropped, fenced blocks looked into, and Python literals taken as a last resort; null if there is none."""
    if not text:
        return None
    fenced = re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)
    for piece in [*reversed(fenced), text]:
        for candidate in reversed(_objects(piece)):
            plain = re.sub(r",(\s*[}\]])", r"\1", re.sub(r"/\*.*?\*/", "", re.sub(r"(?m)(^|[\s,{\[])//.*$", r"\1", candidate), flags=re.S))
            for read in (json.loads, ast.literal_eval):
                try:
                    got = read(plain)
                except (ValueError, SyntaxError):
                    continue
                if isinstance(got, dict):
                    return json.dumps(got, sort_keys=True, ensure_ascii=False)
    return None


def _objects(text: str) -> list[str]:
    """Balanced {...} stretches at the outer level, strings aside."""
    out, depth, start, quoted, skip = [], 0, 0, "", False
    for i, c in enumerate(text):
        if quoted:
            skip, quoted = (False, quoted) if skip else (c == "\\", "" if c == quoted else quoted)
        elif c == '"':
            quoted = c if depth else ""
        elif c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    return out


def instruction(text: str | None, most: int = 40, limit: int = 80) -> str | None:
    """The instruction in an answer: what is quoted after "instruction", else the text; long ones end with a sentence."""
    if text is None:
        return None
    m = re.search(r"(?is)instruction\w*\s*[:=]\s*\"?(.+?)\"?\s*(?:\n\n|\Z)", text)
    words = (m[1] if m else text).split()
    if len(words) <= most:
        return " ".join(words)
    if len(words) > limit:
        words = words[:limit]
    for k in range(min(most, len(words)), max(35, 0), -1):
        if words[k - 1].endswith((".", "!", "?")):
            return " ".join(words[:k])
    return " ".join(words[:most])


def sections(text: str) -> dict[str, str]:
    """A chain of thought by its headed sections: `## Name` or `Name:` on a line of its own."""
    out, name, held = {}, None, []
    for line in text.split("\n"):
        m = re.match(r"^\s*(?:#+\s*([^:]+?)\s*:?|\**([A-Z][\w /-]{1,40})\**\s*:)\s*$", line)
        if m:
            if name:
                out[name] = "\n".join(held).strip()
            name, held = (m[1] or m[2]).strip().lower(), []
        else:
            held.append(line)
    if name:
        out[name] = "\n".join(held).strip()
    return out


def _arrow(fn, returns: str):
    """A column function; the UDF is made when it is called, as types cannot be read before there is a session."""

    def apply(column: Column) -> Column:
        def run(s: pd.Series) -> pd.Series:
            return s.map(fn, na_action="ignore")

        return F.pandas_udf(run, returns, F.PandasUDFType.SCALAR)(column)

    return apply


decomposition_of = _arrow(decomposition, "array<string>")
repaired_json = _arrow(repair_json, "string")
instruction_of = _arrow(instruction, "string")
sections_of = _arrow(sections, "map<string,string>")
key_values_of = _arrow(lambda t: {k: v if isinstance(v, str) else json.dumps(v) for k, v in key_values(t).items()}, "map<string,string>")


def parsed_answer(text: Column) -> Column:
    """``parse_answer`` of the pre-cleaned text, as JSON."""
    return _arrow(lambda t: json.dumps(parse_answer(t), sort_keys=True), "string")(preclean(text))


def media_items(messages: Column) -> Column:
    """The image and video items of nested chat messages array<struct<content: array<struct<type, ...>>>>, in order."""
    items = F.flatten(F.transform(messages, lambda m: m["content"]))
    return F.filter(items, lambda x: x["type"].isin("image", "image_url", "video"))


def stage_bounds(text: Column, titles: tuple[str, ...] = STAGES) -> Column:
    """(name, start, end) of each stage that is titled in a text, by start, from 1: a stage ends where the next begins, the
    last one at the end. All in the JVM."""
    pattern = lambda t: F.lit(rf"(?im)^[#*\s\d.)]*(?:stage\s*\d+\s*[:.-]?\s*)?\Q{t}\E\b")
    found = F.array(*[F.struct(F.coalesce(F.regexp_instr(text, pattern(t)), F.lit(0)).alias("start"), F.lit(t).alias("name")) for t in titles])
    there = F.array_sort(F.filter(found, lambda x: x["start"] > 0))
    after = F.concat(F.slice(F.transform(there, lambda x: x["start"]), F.lit(2), F.greatest(F.size(there), F.lit(1))), F.array(F.length(text) + 1))
    bounds = F.zip_with(there, after, lambda x, e: F.struct(x["name"].alias("name"), x["start"].alias("start"), e.alias("end")))
    return F.slice(bounds, F.lit(1), F.size(there))
