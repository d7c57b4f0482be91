import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markscale.functions import fields
from markscale.functions.text import is_visible, python_float_text, strip


def values(spark, inputs, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_strip_follows_python(spark):
    texts = ["　 EN_01\x1c \n", "a  b", "", " x ", "\x1f\x85y ", "  ", "a\n\nb\n", None, "​z"]
    assert values(spark, texts, strip) == [None if t is None else t.strip() for t in texts]
    assert values(spark, texts, is_visible) == [None if t is None else t.strip() != "" for t in texts]


def test_language_tags(spark):
    tags = [" zh-CN ", "EN-GB", "zh_cn", "", "　zh", "fr", None]
    assert values(spark, tags, fields.canonical_language) == ["cn", "en", "zh_cn", "", "cn", "fr", None]
    kept = lambda c: fields.canonical_language(c, lowercase=False)
    assert values(spark, ["ZH", "zh", " EN-US", "en-us"], kept) == ["ZH", "cn", "EN-US", "en"]


def test_verdicts(spark):
    verdicts = {
        "x [ Correct ]　\n": "correct",
        "[Correct].": "unknown",
        "[a][Incorrect]": "incorrect",
        "[Incorr": "unknown",
        "[ ]": "",
        "[]": "unknown",
        "[x]\n[Correct]": "correct",
        "[[Correct]]": "unknown",
        None: "unknown",
    }
    labels = values(spark, list(verdicts), fields.verdict_label)
    assert labels == list(verdicts.values())
    flags = values(spark, list(verdicts), lambda c: fields.is_correct(fields.verdict_label(c)))
    assert flags == [label == "correct" for label in labels]


def test_language_and_task_of_id(spark):
    ids = ["EN_001", "cnx", "de_1", "", None, " 　En9"]
    assert values(spark, ids, fields.language_from_id) == ["en", "cn", "unknown", "unknown", "unknown", "en"]
    ids = ["en_007", "en_7", "en_x", "x０１", None, "a12\n", "1", "12 "]
    expected = ["07", "unknown", "unknown", "０１", "unknown", "12", "unknown", "12"]
    assert values(spark, ids, fields.task_from_id) == expected


def test_scores_from_text(spark):
    texts = [" 0.5 ", "1e3", "0x1F", "1d", "1f", "1e400", "inf", "-Infinity", "nan", "abc", "true", ".5", "5.", None]
    inf = float("inf")
    expected = [0.5, 1000.0, None, None, None, None, inf, -inf, None, None, None, 0.5, 5.0, None]
    assert values(spark, texts, fields.score_from_text) == expected


def test_scores_from_json(spark):
    texts = ["true", "false", '"0.5"', "1", "1.25", "1e2", '"true"', "null", "[1]", '{"a":1}']
    expected = [1.0, 0.0, 0.5, 1.0, 1.25, 100.0, None, None, None, None]
    assert values(spark, texts, lambda c: fields.score_from_variant(F.parse_json(c))) == expected


def test_scores_of_any_column_type(spark):
    cast = lambda kind: lambda c: fields.coerce_score(c.cast(kind), T._parse_datatype_string(kind))
    assert values(spark, ["2", None], cast("int")) == [2.0, None]
    assert values(spark, ["NaN", "0.5"], cast("double")) == [None, 0.5]
    assert values(spark, ["true", None], cast("boolean")) == [1.0, None]
    assert values(spark, ["2020-01-01"], cast("date")) == [None]


NUMBERS = [0.0, -0.0, 1.0, 0.5, 1e-5, 1e-4, 0.001, 0.002, 123456.789, 1e7, 12345678.9, 1e15, 1e16, 1.5e16, 1e20]
NUMBERS += [-1e20, 1.234e-7, float("inf"), float("-inf"), 1 / 3, 2 / 3 * 1e10, 100.0, math.sqrt(0.25 * 0.75 / 4)]


def test_floats_are_spelled_as_in_python(spark):
    assert values(spark, NUMBERS, python_float_text, "double") == [repr(n) for n in NUMBERS]
    assert values(spark, [float("nan"), None], python_float_text, "double") == ["nan", None]


@pytest.mark.parametrize("length", [200_000])
def test_patterns_are_linear_in_long_texts(spark, length):
    """Long runs of whitespace or brackets inside a text must not blow up."""
    texts = [" " * length + "x" + " " * length + "y", "[" * length + "a" + "]" * length]
    assert values(spark, texts[:1], strip) == [texts[0].strip()]
    assert values(spark, texts, fields.verdict_label) == ["unknown", "unknown"]
