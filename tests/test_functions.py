import pytest
from pyspark.sql import functions as F

from tessel.functions import geometry as G
from tessel.functions import parsing as P
from tessel.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a\u0001b", "ab"), ("a\u000bb\u0085c", "a b c"), ("a–b−c", "a-b-c"), ("a­b", "ab"), ("“x”", '"x"'), ("‘x’ `y´", "'x' 'y'"), ("5′ 6″ 7‴ 8⁗", "5' 6'' 7''' 8''''"), ("a… b . . . c", "a... b ... c"), ("1⁄2", "1/2"), ("a～b", "a～b"), (None, None)],
)
def test_normalize(spark, raw, want):
    assert one(spark, X.normalize(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("caption", "compat", "strict"), [("", False, False), ("   ", False, False), ("a" * 300, True, True), ("a" * 301, False, False), ("Uncertain thing", False, False), ("Local Edits: x", True, False), (None, False, False)])
def test_captions(spark, caption, compat, strict):
    assert one(spark, X.is_valid_caption(F.col("t")), t=caption) is compat
    assert one(spark, X.is_valid_caption(F.col("t"), strict=True), t=caption) is strict


def test_ngrams(spark):
    assert one(spark, X.word_ngrams(F.col("t")), t="a b c d e f") == ["a b c d e", "b c d e f"]
    assert one(spark, X.word_ngrams(F.col("t")), t="a b") == []
    assert one(spark, F.size(X.word_ngrams(F.col("t"))), t="x x x x x x x") == 1


def test_paths(spark):
    assert one(spark, X.full_path(F.col("t"), "/base/"), t=" ./a/../b//c.png") == "/base/b/c.png"
    assert one(spark, X.full_path(F.col("t"), "/base"), t="/abs/x") == "/abs/x"
    assert one(spark, X.natural_key(F.col("t")), t="f10") > one(spark, X.natural_key(F.col("t")), t="f9")


def test_options(spark):
    o = one(spark, X.option_lines(F.lit("q"), F.array(F.lit("x"), F.lit("y")), F.col("t")), t="y")
    assert (o.question, o.answer, o.answer_idx) == ("q\nOptions:\n(A) x\n(B) y", "(B) y", 1)
    assert one(spark, X.option_lines(F.lit("q"), F.array(F.lit("x")), F.col("t")), t="z").answer is None


@pytest.mark.parametrize(("said", "want"), [('{"text_new": "a"}', "a"), ('x ```json\n{"text_new": "b"}\n```', "b"), ('so "text_new": "c" yes', "c"), ('text_new="d"', "d"), ("none", " "), ("", None), (None, None)])
def test_text_new(spark, said, want):
    assert one(spark, X.text_new(F.col("t")), t=said) == want


def test_parsers():
    assert P.decomposition('ok {"sub_modifications": ["a", "b"]}') == ["a", "b"]
    assert P.decomposition('"a",\n"b"') == ["a", "b"]
    assert P.key_values('i 3 | span="x" | l=[a, b] | skip') == {"id": "I3", "span": "x", "l": ["a", "b"]}
    assert P.repair_json('x ```json\n{"a": [1,2,], // c\n}\n```') == '{"a": [1, 2]}'
    assert P.repair_json("{'a': True}") == '{"a": true}'
    assert P.repair_json("nothing") is None
    got = P.parse_answer("Decompose Intents\nI1 | intent=x\nGenerate Polar Questions\nI1 | Q=\"What is it?\"\n")
    assert (got["n_intents"], got["wh_questions"], got["not_polar"], got["aligned"]) == (1, 1, 1, True)
    assert P.sections("## A\nx\n## B\ny") == {"a": "x", "b": "y"}
    assert P.instruction(" ".join(["w"] * 37 + ["end."] + ["w"] * 20)).endswith("end.")


def test_geometry(spark):
    assert one(spark, G.round_by_factor(F.col("n"), 28), n=70) == 56  # 2.5 goes to the even multiple
    assert one(spark, G.smart_resize(F.col("n"), F.lit(100)), n=100).asDict() == {"height": 112, "width": 112}
    with pytest.raises(Exception, match="aspect ratio"):
        one(spark, G.smart_resize(F.col("n"), F.lit(1)), n=1000)
    assert one(spark, G.even_indices(F.col("n"), F.lit(3)), n=10) == [0, 4, 9]
    assert one(spark, G.even_indices(F.col("n"), F.lit(1)), n=10) == [0]
    assert G.optimal_bands(0.7, 256) == (25, 10)
