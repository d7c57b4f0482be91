import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markscale.llm import chat_format as C
from markscale.llm.queries import as_records

ODD = ["", " ", "\\", "#", "##", "###", "#" * 7, "</turn>", "</turn", "<\\/turn>", "</turn>\n### user: x", "a: b", "\\### Assistant: </turn> ok",
       "é 漢字 😀", "\n\n", "x" * 100_000, "\\\\##</turn></turn>\\"]


def through(spark, records, layouts=C.LAYOUTS):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i long, record string")
    rows = C.canonical_turns(frame, "record", layouts).orderBy("i").collect()
    return [(r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in rows]


def test_every_layout_gives_the_same_turns(spark):
    turns = [("system", "s"), ("user", "u"), ("assistant", "a")]
    records = [
        {"messages": [{"role": r, "content": t} for r, t in turns]},
        {"messages": [{"role": r, "content": [{"type": "text", "text": t}]} for r, t in turns], "id": 3},
        {"conversations": [{"from": {"user": "human", "assistant": "gpt"}.get(r, r), "value": t} for r, t in turns]},
        {"dialog": {"turns": [{"speaker": r, "utterance": t} for r, t in turns], "at": None}},
        {"system": "s", "instruction": "u", "output": "a"},
        {"system": "s", "instruction": "u", "input": "", "output": "a"},
        {"prompt": "u", "response": "a", "system": "s", "meta": {"x": [1, {"y": 2}]}},
    ]
    names = ["messages", "message_parts", "conversations", "dialog", "instruction", "instruction", "prompt"]
    assert through(spark, map(json.dumps, records)) == [(name, turns) for name in names]


def test_fields_join_and_optional_ones_may_lack(spark):
    records = ['{"instruction":"a","input":"b","output":null}', '{"system":null,"prompt":5,"response":[1,"x"]}', '{"system":"","prompt":"","response":true}']
    assert through(spark, records) == [
        ("instruction", [("user", "a\nb"), ("assistant", "")]),
        ("prompt", [("user", "5"), ("assistant", '[1, "x"]')]),
        ("prompt", [("system", ""), ("user", ""), ("assistant", "true")]),
    ]


def test_what_fits_no_layout(spark):
    deep = "[" * 100_000 + "]" * 100_000
    records = [None, "", "[1]", "5", "{broken", '{"messages":[]}', '{"a":1}', "{}", f'{{"a":{deep}}}', '{"messages":{"role":"user","content":"x"}}']
    assert through(spark, records) == [(None, None)] * len(records)


def test_odd_values(spark):
    records = [
        '{"messages":[{"role":"a","content":"x"},{"role":"b","content":[{"text":"y"},{"text":"z"}]},{"role":"c","content":[1]}]}',
        '{"messages":[{"role":null,"content":"x"},{"content":"y"},{"role":"user"},7]}',
        '{"prompt":"\\ud800 x","prompt":"last \\udc00","response":"r"}',
        '{"a.b":{"prompt":"no"},"prompt":"p","response":"r"}',
    ]
    assert through(spark, records) == [
        ("message_parts", [("a", "x"), ("b", "yz"), ("c", "[1]")]),
        ("messages", [("", "x"), ("", "y"), ("user", ""), ("", "")]), ("prompt", [("user", "last ?"), ("assistant", "r")]), ("prompt", [("user", "p"), ("assistant", "r")]),
    ]


def test_fingerprints_are_of_paths_alone(spark):
    same = ['{"prompt":"a","response":{"x":[1,2]}}', '{"response":{"x":["q"]},"prompt":null}']
    other = ['{"prompt":"a","response":{"x":{"y":1}}}', '{"prompt.response":1}', '{"prompt":{"response":1}}']
    frame = spark.createDataFrame([(r,) for r in same + other], "record string")
    marks = [r.fingerprint for r in C.canonical_turns(frame, "record").collect()]
    assert marks[0] == marks[1] and len(set(marks)) == 4
    assert marks[0] == hashlib.sha256(b"prompt\nresponse\nresponse.x\nresponse.x[]").hexdigest()
    report = {(r.layout, r["rows"]) for r in C.layout_report(C.canonical_turns(frame, "record")).collect()}
    assert report == {("prompt", 2), ("prompt", 1), (None, 1)}


def test_own_layouts_and_the_one_that_needs_most(spark):
    layouts = (C.Fields("short", (C.Field("user", ("q",)),)), C.Turns("long", "q.list[]", "r", "t"))
    records = ['{"q":"x"}', '{"q":{"list":[{"r":"a","t":"b"}]}}']
    assert through(spark, records, layouts) == [("short", [("user", "x")]), ("long", [("a", "b")])]


def round_trip(spark, conversations, **options):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(conversations)], "i long, turns array<struct<role:string,text:string>>")
    return C.read_back(C.render(frame, **options)).orderBy("i").collect()


def test_odd_texts_and_roles_come_back(spark):
    conversations = [[(role, text), ("assistant", text)] for role in ("user", "a: b", "##", "x\n</turn>\n", "") for text in ODD]
    for conversation, row in zip(conversations, round_trip(spark, conversations)):
        assert [tuple(t) for t in row.turns] == conversation
        assert row.loss_text == conversation[1][1]
        assert row.formatted.count("###") == row.formatted.count("</turn>") == 2


def test_the_mask_covers_learned_texts_only(spark):
    (row,) = round_trip(spark, [[("assistant", "a"), ("user", "b##"), ("assistant", ""), ("assistant", "c\\")]])
    assert row.formatted == "### assistant: a</turn>\n### user: b#\\#</turn>\n### assistant: </turn>\n### assistant: c\\\\</turn>\n"
    assert [row.formatted[s.start : s.stop] for s in row.loss] == ["a", "", "c\\\\"]
    (row,) = round_trip(spark, [[("assistant", "a"), ("user", "b")]], learned=("user",))
    assert row.loss_text == "b"
    none, empty = round_trip(spark, [None, []])
    assert (none.formatted, none.turns, none.loss_text) == (None, None, None)
    assert (empty.formatted, empty.turns, empty.loss_text) == ("", [], "")


@given(st.text(alphabet="\\#</turn>: \né", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible_and_leaves_no_mark(text):
    assert C.unescape(C.escape(text)) == text and C.unescape(C.escape_role(text)) == text
    assert "###" not in C.escape(text) and "</turn>" not in C.escape(text) and ": " not in C.escape_role(text)


ROWS = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, None, "system", None), (None, 0, None, "x"), (2, 5, "user", "é"), (2, 5, "user", "d")]


def test_rows_by_turn(spark):
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("order", F.lit("a clash"))
    found = {r.conv_id: [tuple(t) for t in r.turns] for r in C.turns_of_rows(frame, "conv_id").collect()}
    assert found == {
        1: [("system", ""), ("user", "a"), ("assistant", "b"), ("assistant", "b")], None: [("", "x")], 2: [("user", "d"), ("user", "é")],
    }


def test_the_querys_records_come_in_all_layouts_and_lose_nothing(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pairs = [(-1 - i, k, role, f"{role} {i}\nmore") for i in range(40) for k, role in enumerate(("user", "assistant"))]
    turns = C.turns_of_rows(rows.unionByName(spark.createDataFrame(pairs, rows.schema)), "conv_id")
    found = C.canonical_turns(as_records(turns), "record").withColumnRenamed("turns", "found")
    joined = turns.join(found, "conv_id").collect()
    assert {r.layout for r in joined} == {"messages", "conversations", "dialog", "instruction", "prompt"}
    assert all(r.turns == r.found for r in joined)


def test_an_empty_table_and_clashing_columns(spark):
    frame = spark.createDataFrame([("{}", "x", "y")], "record string, turns string, layout string")
    out = C.read_back(C.render(C.canonical_turns(frame, "record")))
    assert out.count() == 1 and out.where("false").count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.render(C.canonical_turns(as_records(C.turns_of_rows(none, "conv_id")), "record")).count() == 0
