import json

import pytest
from pyspark.sql import functions as F

from markscale.functions.records import object_text
from markscale.functions.templates import chat_messages, render
from markscale.operators import prep, prompts
from markscale.sources.jsonl import parse_records


def edited(spark, objects, edit):
    """Apply an edit to JSON objects (or lines) and give the resulting lines."""
    lines = [o if isinstance(o, str) else json.dumps(o, ensure_ascii=False) for o in objects]
    frame = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    rows = edit(parse_records(frame)).orderBy("i").select(object_text(F.col("record")))
    return [r[0] for r in rows.collect()]


def test_records_keep_unknown_keys_order_nulls_and_text(spark):
    line = '{"z":{"b":[1,null,{"c":"中文"}]},"a":null,"n":12345678901234567890,"t":"q\\"\\n"}'
    assert edited(spark, [line], lambda df: df) == [line]


def test_last_of_repeated_keys_counts(spark):
    line = '{"a":1,"b":2,"a":3}'
    assert json.loads(line) == {"a": 3, "b": 2}
    assert edited(spark, [line], lambda df: df) == ['{"a":3,"b":2}']


def test_generation_fields_are_dropped(spark):
    rows = [{"model": "m", "id": 1, "answer": "a"}, {"id": 2}]
    assert edited(spark, rows, prep.drop_generation_fields) == ['{"id":1}', '{"id":2}']


def test_legacy_language_key(spark):
    rows = [{",language": "x", "a": 1}, {"language": "y", ",language": "x"}, {"language": None, ",language": "x"}, {"a": 1}]
    assert edited(spark, rows, prep.rename_legacy_language) == [
        '{"a":1,"language":"x"}',
        '{"language":"y",",language":"x"}',
        '{"language":null,",language":"x"}',
        '{"a":1}',
    ]


def test_language_values(spark):
    rows = [{"language": v, "a": 1} for v in (" zh-CN ", "", 5, None, ["en-us"])] + [{"a": 1}]
    expected = [{"language": v, "a": 1} for v in ("cn", "", 5, None, ["en-us"])] + [{"a": 1}]
    assert [json.loads(r) for r in edited(spark, rows, prep.canonicalise_language)] == expected


def test_rows_without_a_language_are_dropped(spark):
    rows = [{"language": ""}, {"language": 5}, {"language": None, ",language": "en"}, {",language": "en"}, {"a": 1}]
    assert edited(spark, rows, prep.drop_missing_language) == ['{"language":""}', '{",language":"en"}']


# The JSON text of an id, and of what it becomes.
IDS = {
    "null": '"None"', "true": '"True"', "false": '"False"', '" a "': '"a"', "12": '"12"', "-3": '"-3"', "-0": '"0"',
    "1.0": '"1.0"', "-0.0": '"-0.0"', "1.50": '"1.5"', "1e20": '"1e+20"', "1e-7": '"1e-07"', "1e400": '"inf"',
    "12345678.5": '"12345678.5"', "[1]": "[1]", '{"b": 1}': '{"b":1}', '"　x"': '"x"',
    "123456789012345678901234567890123456789012": '"123456789012345678901234567890123456789012"',
}


def test_ids_are_spelled_as_in_python(spark):
    lines = [f'{{"k":1,"id":{i},"z":2}}' for i in IDS] + ['{"k":1}', '{"id":1.5,"id":2.5}']
    expected = [f'{{"k":1,"id":{i},"z":2}}' for i in IDS.values()] + ['{"k":1}', '{"id":"2.5"}']
    assert edited(spark, lines, prep.stringify_id) == expected


def test_ids_follow_earlier_edits(spark):
    edit = lambda df: prep.stringify_id(prep.extend_records(df, {"id": F.lit(8)}))
    assert edited(spark, ['{"id":1.5}'], edit) == ['{"id":"8"}']


def test_values_are_kept_as_they_came(spark):
    values = {
        "1.0": "1.0", "-0.0": "-0.0", "1e5": "100000.0", "1e400": "1e999", "-1e400": "-1e999", "0.10": "0.1", "[1, 2.50]": "[1,2.5]",
        '{"a":  null}': '{"a":null}', "true": "true", '"\\u00e9 \\n"': '"é \\n"', '""': '""', '"Infinity"': '"Infinity"', "12" * 20: "12" * 20,
        "null": "null", "[1.0, -0.0]": "[1.0,-0.0]",
    }
    lines = [f'{{"a":{v},"b":1}}' for v in values]
    expected = [f'{{"a":{v},"b":1}}' for v in values.values()]
    assert edited(spark, lines, lambda df: df) == expected
    assert edited(spark, lines, lambda df: prep.extend_records(df, {"b": F.lit("x")})) == [e.replace('"b":1', '"b":"x"') for e in expected]


def test_prompts_spell_values_as_python_does(spark):
    texts = {"1.0": "1.0", "[1, 2]": "[1, 2]", "[1,2.50]": "[1, 2.5]", '{"a":null}': "{'a': None}", "1e+22": "1e+22", "-0.0": "-0.0", "null": "None", '"é"': "é"}
    lines = [f'{{"text":{t},"question":true}}' for t in texts]
    got = edited(spark, lines, lambda df: prep.render_prompt(df, "{text}|{problem}"))
    assert [json.loads(g)["input"] for g in got] == [f"{t}|True" for t in texts.values()]


def test_null_ids_can_be_kept(spark):
    keep = lambda df: prep.stringify_id(df, null_id="keep")
    assert edited(spark, [{"id": None}, {"id": 1}], keep) == ['{"id":null}', '{"id":"1"}']
    with pytest.raises(ValueError):
        prep.stringify_id(spark.createDataFrame([], "record map<string,string>"), null_id="x")


def test_normalize_is_the_three_steps(spark):
    rows = [{",language": " ZH ", "id": 7}, {"language": 1, "id": None}, {"id": "x"}]
    assert edited(spark, rows, prep.normalize) == [
        '{"id":"7","language":"cn"}',
        '{"language":1,"id":"None"}',
        '{"id":"x"}',
    ]
    assert len(edited(spark, rows, lambda df: prep.normalize(df, drop_missing=True))) == 1


TEMPLATE = "T:{text},Q:{problem} {{z}}"


def test_prompt_is_not_expanded_twice(spark):
    rows = [{"id": 1, "text": "a {problem}", "question": "q"}, {"question": None}, {}]
    out = edited(spark, rows, lambda df: prep.render_prompt(df, TEMPLATE))
    assert out == ['{"id":1,"input":"T:a {problem},Q:q {z}"}', '{"input":"T:,Q:None {z}"}', '{"input":"T:,Q: {z}"}']


def test_prompt_fields_can_be_named_and_kept(spark):
    rows = [{"text": "t", "q": True, "x": 5}]
    keep = lambda df: prep.render_prompt(df, TEMPLATE, question_field="q", drop_source_fields=False)
    assert edited(spark, rows, keep) == ['{"text":"t","q":true,"x":5,"input":"T:t,Q:True {z}"}']
    onto = lambda df: prep.render_prompt(df, TEMPLATE, question_field="q", target_field="text")
    assert edited(spark, rows, onto) == ['{"text":"T:t,Q:True {z}","x":5}']


@pytest.mark.parametrize("template", ["{other}", "{text!r}", "{text:>5}", "{text.upper}", "{}", "{0}"])
def test_bad_templates_fail_before_the_job(template):
    with pytest.raises(ValueError):
        render(template, {"text": None, "problem": None})


def test_typed_prompts(spark):
    df = spark.createDataFrame([("t", None, "r"), (None, "q", "r")], "text string, question string, reference string")
    out = prompts.with_prompt(df, TEMPLATE).select("input", "reference").collect()
    assert [tuple(r) for r in out] == [("T:t,Q: {z}", "r"), ("T:,Q:q {z}", "r")]
    prompt = prompts.answer_prompt(F.col("text"), F.col("question"), TEMPLATE)
    assert [r[0] for r in df.select(prompt).collect()] == ["T:t,Q:None {z}", "T:None,Q:q {z}"]
    slots = [F.col(name) for name in ("question", "text", "reference")]
    judged = prompts.judge_prompt(*slots, "{question}|{prediction}|{reference}")
    assert [r[0] for r in df.select(judged).collect()] == ["|t|r", "q||r"]
    default = prompts.judge_prompt(F.lit("QQ"), F.lit("AA"), F.lit("RR"))
    assert df.select(default).first()[0].endswith("Question: QQ\nAnswer: AA\nReference: RR\nVerdict:")


def test_chat_messages(spark):
    one = spark.range(1)
    with_system = one.select(chat_messages(F.lit("p"), "s")).first()[0]
    assert [tuple(m) for m in with_system] == [("system", "s"), ("user", "p")]
    for none in (None, ""):
        assert [tuple(m) for m in one.select(chat_messages(F.lit("p"), none)).first()[0]] == [("user", "p")]
    rows = spark.createDataFrame([("p", "own"), ("q", ""), (None, None)], "p string, s string")
    got = [[tuple(m) for m in r[0]] for r in rows.select(chat_messages(F.col("p"), F.col("s"))).collect()]
    assert got == [[("system", "own"), ("user", "p")], [("user", "q")], [("user", None)]]
