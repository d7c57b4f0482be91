import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markscale.functions import records as R
from markscale.functions.records import object_text
from markscale.sources import sinks
from markscale.sources.jsonl import list_files, read_lines, read_manifest, read_records, read_rows

BROKEN = ["{bad", "[1]", "3", "null", '{"id":"x"} x', '{"id":"x"}{"id":"y"}', '{"id":"x"},{"id":"y"}', '{"id":"x"}]g']
BROKEN += ["{'id':'x'}", '{"id":"x",}', '{"id":01}', '{"id":"x"', '{"id":"x"},{}]']


def test_lenient_scan_keeps_valid_rows_only(spark, write_lines):
    folder = write_lines(a=['{"id":"1"}', "", " 　 ", *BROKEN, '{"id":"2","similarity":"abc","x":[1]}'])
    rows = read_rows(spark, folder)
    assert sorted(r.id for r in rows.collect()) == ["1", "2"]
    assert rows.count() == 2


@pytest.mark.parametrize("line", BROKEN)
def test_strict_scan_fails_on_a_broken_line(spark, write_lines, line):
    with pytest.raises(Exception, match="not one JSON object"):
        read_records(spark, write_lines(a=['{"id":"1"}', line])).collect()


def test_strict_scan_of_blank_lines(spark, write_lines):
    folder = write_lines(a=['{"id":"1"}', "", " 　\t"])
    assert read_records(spark, folder).count() == 1
    with pytest.raises(Exception, match="not one JSON object"):
        read_records(spark, folder, blank_lines="error").collect()
    schema = T.StructType([T.StructField("id", T.StringType())])
    assert [r.id for r in read_rows(spark, folder, schema, strict=True).collect()] == ["1"]
    with pytest.raises(ValueError):
        read_records(spark, folder, blank_lines="x")


def test_missing_null_and_boolean_scores_stay_apart(spark, write_lines):
    lines = ['{"id":"a"}', '{"id":"b","similarity":null}', '{"id":"c","similarity":true}', '{"id":"d","similarity":"true"}']
    rows = read_rows(spark, write_lines(a=lines)).orderBy("id")
    kinds = rows.select(F.schema_of_variant("similarity"), F.col("similarity").isNull()).collect()
    assert [tuple(k) for k in kinds] == [(None, True), ("VOID", False), ("BOOLEAN", False), ("STRING", False)]


def test_folder_file_and_glob(spark, write_lines, tmp_path):
    folder = write_lines(b=['{"id":"1"}'], a=['{"id":"2"}'], empty=[])
    (tmp_path / "in" / "notes.txt").write_text('{"id":"no"}\n')
    nested = tmp_path / "in" / "deep"
    nested.mkdir()
    (nested / "c.jsonl").write_text('{"id":"no"}\n')
    found = {(r.source_file, json.loads(r.line)["id"]) for r in read_lines(spark, folder).collect()}
    assert found == {("a", "2"), ("b", "1")}
    assert {r.source_file for r in list_files(spark, folder).collect()} == {"a", "b", "empty"}
    assert [r.source_file for r in read_lines(spark, f"{folder}/a.jsonl").collect()] == ["a"]
    assert [r.source_file for r in read_lines(spark, f"{folder}/*a.jsonl").collect()] == ["a"]
    assert [r.source_file for r in read_lines(spark, f"{folder}/notes.txt", pattern=None).collect()] == ["notes.txt"]


def test_written_files_are_listed_by_their_names(spark, tmp_path):
    df = spark.createDataFrame([("a b", 1), ("x=%1", 2), ("中", 3)], "source_file string, n int")
    sinks.write_rows(df, str(tmp_path / "out"))
    listed = list_files(spark, str(tmp_path / "out"), written=True)
    assert {r.source_file for r in listed.collect()} == {"a b", "x=%1", "中"}
    assert {r.source_file for r in read_lines(spark, str(tmp_path / "out"), written=True).collect()} == {"a b", "x=%1", "中"}


def test_empty_folder_gives_no_rows(spark, tmp_path):
    assert read_rows(spark, str(tmp_path)).count() == 0


def test_record_sink_round_trip(spark, write_lines, tmp_path):
    lines = ['{"z":"中","a":null,"k":{"x":[1,2]}}', '{"id":1}']
    rows = read_records(spark, write_lines(one=lines[:1], two=lines[1:]))
    target = str(tmp_path / "out")
    sinks.write_records(sinks.prefixed(rows, sinks.JUDGED_PREFIX), target)
    back = read_lines(spark, target, written=True).collect()
    assert {(r.source_file, r.line) for r in back} == {("llmjudge_one", lines[0]), ("llmjudge_two", lines[1])}
    sinks.write_records(rows.limit(0), target)
    assert read_lines(spark, target, written=True).count() == 0


def test_row_sink_writes_nulls_and_literal_unicode(spark, tmp_path):
    df = spark.createDataFrame([("f", "中", None)], "source_file string, `LLMJudge result` string, n int")
    sinks.write_rows(df, str(tmp_path / "out"))
    line = read_lines(spark, str(tmp_path / "out"), written=True).first()
    assert tuple(line) == ("f", '{"LLMJudge result":"中","n":null}')


def test_csv_sink(spark, tmp_path):
    rows = [("f", "b,c", 2, 1e-5), ("f", ' a"x ', 1, None), ("f", "", 3, float("nan")), ("g", "line\nbreak", 1, 0.5)]
    df = spark.createDataFrame(rows, "source_file string, model string, n_total bigint, mean double")
    sinks.write_csv(df, str(tmp_path / "csv"), ["model"])

    def text(name):
        parts = sorted((tmp_path / "csv" / f"source_file={name}").glob("part-*"))
        return parts, "".join(p.read_text() for p in parts)

    parts, body = text("f")
    lines = [line for line in body.splitlines() if line != "model,n_total,mean"]
    assert lines == [",3.0,", '" a""x ",1.0,', '"b,c",2.0,1e-05']
    assert text("g")[1] == 'model,n_total,mean\n"line\nbreak",1.0,0.5\n'


@pytest.mark.parametrize("line", ['{"id":"x","LLMJudge result":"' + "v" * 21_000_000 + '"}', '{"id":"x","deep":' + "[" * 1500 + "]" * 1500 + "}"])
def test_long_and_deep_rows_come_through(spark, write_lines, line):
    folder = write_lines(a=[line])
    row = read_rows(spark, folder).first()
    assert row.id == "x" and len(row["LLMJudge result"] or "") in (0, 21_000_000)
    size = read_records(spark, folder).select(F.sum(F.length(object_text(F.col("record"))))).first()[0]
    assert size == len(line)


def test_rows_beyond_the_parsers_depth_fail_the_strict_scan_only(spark, write_lines):
    folder = write_lines(a=['{"id":"x","deep":' + "[" * 100_000 + "]" * 100_000 + "}"])
    assert read_rows(spark, folder).first().id == "x"
    with pytest.raises(Exception, match="not one JSON object"):
        read_records(spark, folder).collect()


def test_a_line_is_parsed_once(spark, write_lines):
    rows = read_records(spark, write_lines(a=['{"id":1}'])).where(F.col("record")["id"] == "1")
    plan = rows.withColumn("more", F.map_keys("record"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("record_of(") == 1 and "from_json" not in plan


def test_lines_are_parsed_in_bounded_pieces():
    lines = [json.dumps({"n": n, "text": "x" * (n % 7)}) for n in range(3 * R.PIECE_ROWS)] + [None, "", "{"]
    long = ['{"text":"' + "y" * (R.PIECE_BYTES // 3) + '"}'] * 7 + ['{"text":"' + "z" * 2 * R.PIECE_BYTES + '"}', "{}"]
    batches = [pa.array(lines), pa.array([], pa.string()), pa.array(long), pa.array(["no", *long]).slice(1)]
    out = list(R.record_of.func(iter(batches)))
    assert max(len(piece) for piece in out) <= R.PIECE_ROWS
    assert all(len(piece) == 1 or piece.nbytes <= 2 * R.PIECE_BYTES for piece in out)
    rows = [row for piece in out for row in piece.to_pylist()]
    texts = [line for batch in batches for line in batch.to_pylist()]
    assert rows == [R._pairs(line) for line in texts] and rows[1] == [("n", "1"), ("text", '"x"')]


def test_printed_values_are_those_of_a_second_reading(spark, write_lines):
    values = ['[1,2.50,NaN,"a\'b",null,true]', '{"k":{"x":[1e400,"\\ud83d"]},"k":"中\\n"}', '"s"', "[]", "3", "null", "[" + "9" * 20 + "]"]
    folder = write_lines(a=[f'{{"q":[0],"t":{value},"t2":[1]}}' for value in values] + ['{"q":{}}'])
    record, printed = F.col("record"), F.col("printed")

    def shown(key, **more):
        return R.spelled(record, key, absent="", null="None", **more)

    rows = read_records(spark, folder, printed=("t", "q"))
    assert rows.columns == ["source_file", "line", "record", "printed"]
    found = rows.select(shown("t").alias("a"), shown("t", printed=printed).alias("b"), shown("q", printed=printed).alias("q"), "printed").collect()
    assert [r.a for r in found] == [r.b for r in found]
    assert found[0].b == """[1, 2.5, nan, "a'b", None, True]""" and found[-1].q == "{}" and "t2" not in found[0].printed
    with pytest.raises(Exception, match="not one JSON object"):
        read_records(spark, write_lines(a=["[1]"]), printed=("t",)).collect()


@pytest.mark.parametrize(
    ("line", "written"),
    [
        ('{"a":NaN}', '{"a":NaN}'),
        ('{"a":"NaN","b":"Infinity"}', '{"a":"NaN","b":"Infinity"}'),
        ('{"a":Infinity,"b":-Infinity}', '{"a":1e999,"b":-1e999}'),
        ('{"a":[NaN,1.0]}', '{"a":[NaN,1.0]}'),
        ('{"a":"\\ud83d\\ude00","b":"\\ud83d"}', '{"a":"😀","b":"\\ud83d"}'),
        ('{"a":1,"b":2,"a":3}', '{"a":3,"b":2}'),
        ("\u3000{} ", "{}"),
        ('{"a":' + "9" * 5000 + "}", '{"a":' + "9" * 5000 + "}"),
        ('{"a":"x\\u2028y/\\/"}', '{"a":"x\u2028y//"}'),
    ],
)
def test_values_are_written_as_they_were_read(spark, write_lines, line, written):
    rows = read_records(spark, write_lines(a=[line]))
    assert [r.line for r in rows.select(object_text(F.col("record")).alias("line")).collect()] == [written]


def test_plain_files_with_a_manifest(spark, tmp_path):
    path = str(tmp_path / "plain")
    rows = [("a b", '{"id":"1"}'), ("a b", '{"id":"é"}'), ("x=%1", "{}"), ("c+d", "{}"), ("中", " ")]
    files = spark.createDataFrame([("none",), ("none",), ("a b",)], "source_file string")
    for _ in range(2):  # what was there before is replaced
        sinks.write_plain(spark.createDataFrame(rows, "source_file string, line string"), path, files=files)
    assert sorted(p.name for p in (tmp_path / "plain").glob("*.jsonl")) == sorted(["a b.jsonl", "c+d.jsonl", "none.jsonl", "x=%1.jsonl", "中.jsonl"])
    assert sorted((tmp_path / "plain" / "a b.jsonl").read_text().splitlines()) == ['{"id":"1"}', '{"id":"é"}']
    manifest = {tuple(r) for r in read_manifest(spark, path).collect()}
    assert manifest == {("a b", 2, 23), ("none", 0, 0), ("x=%1", 1, 3), ("c+d", 1, 3), ("中", 1, 2)}
    assert all((tmp_path / "plain" / f"{name}.jsonl").stat().st_size == size for name, _, size in manifest)
    assert {r.source_file for r in list_files(spark, path).collect()} == {name for name, _, _ in manifest}
    assert {(r.source_file, r.line) for r in read_lines(spark, path).collect()} == set(rows)
    sinks.write_plain(spark.createDataFrame([], "source_file string, line string"), path)
    assert read_lines(spark, path).count() == 0 and read_manifest(spark, path).count() == 0
