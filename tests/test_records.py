"""Settings, shapes of records, numbering and fetching, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessel.functions import parsing as P
from tessel.operators import records as R
from tessel.operators.numbering import numbered
from tessel.plans.lineage import Scratch, cut, free_name
from tessel.sources import config, files

SETTINGS = """
# a comment
model:
  name: "a: b"
  sizes: [1, 2.5, x]
  deep:
    on: true
    off: False
    none: ~
list:
- 1
- two
nested:
  - a
  - 'b'
top: text # not this
empty:
"""


def test_settings():
    found = config.parse_settings(SETTINGS)
    assert found == {"model": {"name": "a: b", "sizes": [1, 2.5, "x"], "deep": {"on": True, "off": False, "none": None}}, "list": [1, "two"], "nested": ["a", "b"], "top": "text", "empty": None}
    assert config.with_defaults(found, {"empty": 3, "model": {"more": 1}, "list": [9]})["model"]["more"] == 1
    assert config.with_defaults(found, {"empty": 3})["empty"] == 3
    assert config.parse_settings("") == {}


def test_settings_and_arguments_in_files(spark, tmp_path):
    at = f"file://{tmp_path}"
    assert config.read_settings(spark, f"{at}/none.yaml", {"a": 1}) == {"a": 1}
    config.put_text(spark, f"{at}/a.yaml", "a: 2\n")
    assert config.read_settings(spark, f"{at}/a.yaml", {"a": 1, "b": 0}) == {"a": 2, "b": 0}
    config.save_args(spark, f"{at}/args.json", {"x": [1, None], "y": "é"})
    assert config.load_args(spark, f"{at}/args.json") == {"x": [1, None], "y": "é"}
    config.put_text(spark, f"{at}/bad.json", "__import__('os')")
    with pytest.raises(ValueError):
        config.load_args(spark, f"{at}/bad.json")


def test_retry():
    asked = []

    def read():
        asked.append(1)
        if len(asked) < 3:
            raise OSError("not yet")
        return "rows"

    assert config.with_retry(read, wait=0) == "rows" and len(asked) == 3
    with pytest.raises(OSError):
        config.with_retry(lambda: (_ for _ in ()).throw(OSError()), attempts=2, wait=0)


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_numbers(spark, n):
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    rows = spark.createDataFrame([(i, -1) for i in ids], "id long, pos long").repartition(3)
    got = numbered(rows, "id")
    assert got.columns == ["id", "pos"] and sorted(map(tuple, got.collect())) == [(i, i) for i in range(n)]


SHAPES = [('["a", "b"]', ["a", "b"]), ('[["a"], ["b", "c"]]', ["a", "b", "c"]), ('{"x": ["q"], "y": ["a", "b"]}', ["a", "b"]), ('{"x": ["q", "r"], "y": ["a", "b"]}', ["q", "r"]), ('{"a": {"t": "1"}, "b": {"t": "2"}}', ["1", "2"]), ('{"x": "t"}', ["t"]), (" text ", ["text"]), ("", []), ("[]", [])]


def test_shapes(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SHAPES)], "i int, t string")
    assert [r.c for r in rows.select("i", R.captions(F.col("t")).alias("c")).orderBy("i").collect()] == [w for _, w in SHAPES]


def test_same_image(spark):
    pairs = [("a.png", "./a.png", True), ("x/a.png", "a.png", True), ("/d/x/../a.png", "a.png", True), ("x/a.png", "y/a.png", False), ("a.png", "b.png", False), (None, "a.png", False)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r.s for r in rows.select("i", R.same_image(F.col("a"), F.col("b"), "/d").alias("s")).orderBy("i").collect()] == [w for *_, w in pairs]


def test_stage_bounds(spark):
    text = "x\n## Local Edits\nb\nStage 2: Decompose Intents\nc"
    rows = spark.createDataFrame([(text,), ("none",), ("",)], "t string").select(P.stage_bounds(F.col("t")).alias("b"))
    got = [[(x["name"], text[x["start"] - 1 : x["end"] - 1]) for x in r.b] for r in rows.collect()]
    assert got == [[("Local Edits", "## Local Edits\nb\n"), ("Decompose Intents", "Stage 2: Decompose Intents\nc")], [], []]


def test_fetch(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"file")
    rows = spark.createDataFrame([(1, "data:text/plain;base64,aGk="), (2, "data:,a%20b"), (3, f"{tmp_path}/a.bin"), (4, f"file://{tmp_path}/a.bin"), (5, f"{tmp_path}/none"), (6, "http://x"), (7, None)], "i int, a string")
    got = {r.i: r.content for r in files.fetch(rows, "a").collect()}
    assert {k: bytes(v) if v is not None else None for k, v in got.items()} == {1: b"hi", 2: b"a b", 3: b"file", 4: b"file", 5: None, 6: None, 7: None}


def test_processor_and_loss_tables(spark):
    rows = spark.createDataFrame([("llava",), ("other",)], "f string")
    assert rows.where("f = 'llava'").select(R.process(F.col("f"), F.lit("i"), F.lit("t")).alias("p")).first().p == "<image> i t"
    with pytest.raises(Exception, match="no processor for other"):
        rows.select(R.process(F.col("f"), F.lit("i"), F.lit("t"))).collect()
    with pytest.raises(ValueError):
        R.loss("margin")(R.margin)


def test_scratch_tables_go(spark):
    with Scratch() as scratch:
        inner = scratch.cut(spark.range(5))
        out = scratch.keep(inner.where("id > 1"))
    assert out.count() == 3
    with pytest.raises(Exception):
        inner.count()
    assert free_name("id", out) == "id_0" and cut(out).count() == 3
