"""Settings: files of keys and values with defaults, and arguments as JSON. All go through the file systems that Spark reads."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small file."""
    p, fs = _at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    """One small file as a whole."""
    return spark.read.text(path, wholetext=True).first()[0]


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in "\"'" and len(text) > 1 and text[-1] == text[0]:
        return text[1:-1]
    text = text.split(" #")[0].strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    known = {"": None, "null": None, "~": None, "true": True, "false": False}
    if text.lower() in known:
        return known[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_settings(text: str) -> dict[str, Any]:
    """Keys with values, nested by indentation, and lists of dashes or in brackets; comments are passed over."""
    root: dict[str, Any] = {}
    open_: list[tuple[int, Any]] = [(-1, root)]
    pending: tuple[int, dict, str] | None = None
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or bare.startswith("#") or bare == "---":
            continue
        depth = len(line) - len(line.lstrip())
        listed = bare == "-" or bare.startswith("- ")
        if pending:
            at, holder, key = pending
            if depth > at or listed and depth == at:
                holder[key] = [] if listed else {}
                open_.append((depth, holder[key]))
            pending = None
        while open_[-1][0] > depth or open_[-1][0] == depth and listed != isinstance(open_[-1][1], list):
            open_.pop()
        if open_[-1][0] < depth and open_[-1][1] is root and root == {}:
            open_.append((depth, root))
        holder = open_[-1][1]
        if listed:
            holder.append(_scalar(bare[1:]))
            continue
        key, _, value = bare.partition(":")
        holder[key.strip()] = _scalar(value)
        if not value.split(" #")[0].strip():
            pending = depth, holder, key.strip()
    return root


def with_defaults(found: dict[str, Any], defaults: dict[str, Any]) -> dict[str, Any]:
    """``found`` over ``defaults``, in nested mappings too; a null stands for the default."""
    out = dict(defaults)
    for k, v in found.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = with_defaults(v, out[k])
        elif v is not None or k not in out:
            out[k] = v
    return out


def read_settings(spark: SparkSession, path: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """The settings of a file over the defaults; a file that is not there gives the defaults."""
    p, fs = _at(spark, path)
    return with_defaults(parse_settings(get_text(spark, path)) if fs.exists(p) else {}, defaults)


def save_args(spark: SparkSession, path: str, args: dict[str, Any]) -> None:
    put_text(spark, path, json.dumps(args, sort_keys=True, indent=1, default=str))


def load_args(spark: SparkSession, path: str) -> dict[str, Any]:
    """What ``save_args`` wrote: JSON and nothing else, so that no content is ever run."""
    return json.loads(get_text(spark, path))


def with_retry(read: Callable[[], DataFrame], attempts: int = 3, wait: float = 0.2) -> DataFrame:
    """What ``read`` gives, asked again after growing waits while it fails; the last failure is raised."""
    for attempt in range(attempts):
        try:
            return read()
        except Exception:
            if attempt + 1 == attempts:
                raise
            time.sleep(wait * 2**attempt)
    raise ValueError("no attempts")


def read_json(spark: SparkSession, path: str, schema: str, attempts: int = 3, wait: float = 0.2) -> DataFrame:
    """A JSON file or lines of a declared schema, which is waited for."""
    return with_retry(lambda: spark.read.schema(schema).option("multiLine", True).json(path), attempts, wait)
