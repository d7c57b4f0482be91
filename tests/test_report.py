import json
import math
import statistics

import pytest
from pyspark.sql import functions as F

from markscale.operators import report as report_module
from markscale.operators.measures import Measure, row_count
from markscale.operators.report import report, result_table
from markscale.plans import catalog, stages
from markscale.sources import sinks
from markscale.sources.jsonl import read_rows

SCHEMA = "id string, model string, `LLMJudge result` string, similarity double"


def groups(results, name, keys):
    rows = result_table(results, name).collect()
    return {tuple(r[k] for k in keys): r for r in rows}


def test_measures(spark):
    rows = [
        ("en_01", "m", "[Correct]", 1.0),
        ("en_01", "m", "[Incorrect]", 2.0),
        ("cn_02", "m", None, None),
        ("x", "m", "[ correct ] ", float("nan")),
        ("x", "one", "[Correct]", 3.0),
        ("x", "none", "?", None),
    ]
    results = report(spark.createDataFrame(rows, SCHEMA))
    table = groups(results, "by_model", ["model"])
    m = table[("m",)]
    assert (m.n_total, m.similarity_mean, m.accuracy) == (4, 1.5, 0.5)
    assert m.similarity_se == pytest.approx(0.5)
    assert m.accuracy_se == pytest.approx(math.sqrt(0.5 * 0.5 / 4))
    assert (table[("one",)].similarity_mean, table[("one",)].similarity_se) == (3.0, 0.0)
    assert (table[("none",)].similarity_mean, table[("none",)].similarity_se) == (None, None)
    assert set(groups(results, "by_model_language", ["model", "language"])) == {
        ("m", "en"), ("m", "cn"), ("m", "unknown"), ("one", "unknown"), ("none", "unknown")
    }
    assert groups(results, "by_model_task", ["model", "task_type"])[("m", "01")].n_total == 2


def test_missing_keys_drop_out_of_their_tables_only(spark):
    rows = [(None, "m", "[Correct]", 1.0), ("en_1", None, "[Correct]", 1.0)]
    rows += [(" en_1", "m", None, 1.0), ("en_1", "m", None, 1.0)]
    results = report(spark.createDataFrame(rows, SCHEMA), count_unknown=True)
    assert groups(results, "by_model", ["model"])[("m",)].n_total == 3
    assert groups(results, "by_model", ["model"])[("m",)].n_unknown == 2
    ids = groups(results, "by_model_language_id", ["model", "language", "id"])
    assert set(ids) == {("m", "en", " en_1"), ("m", "en", "en_1")}
    assert set(groups(results, "by_model_language", ["model", "language"])) == {("m", "en"), ("m", "unknown")}


def test_missing_columns(spark):
    df = spark.createDataFrame([("en_1", "m")], "id string, model string")
    row = groups(report(df), "by_model", ["model"])[("m",)]
    assert (row.n_total, row.similarity_mean, row.accuracy, row.accuracy_se) == (1, None, 0.0, 0.0)
    with pytest.raises(ValueError):
        report(df.drop("id"))
    with pytest.raises(ValueError):
        report(df.drop("model"))


def test_score_is_chosen_per_file_by_the_existence_of_the_key(spark, write_lines):
    def line(**extra):
        return json.dumps({"id": "en_01", "model": "m", **extra})

    folder = write_lines(
        first=[line(similarity=0.5, strict_semantic_score=9), line(strict_semantic_score=9)],
        nulls=[line(similarity=None, strict_semantic_score=0.25)],
        second=[line(strict_semantic_score="0.25"), line(strict_semantic_score=True)],
        neither=[line()],
    )
    results = stages.aggregate(spark, folder)
    means = {r.source_file: r.similarity_mean for r in result_table(results, "by_model").collect()}
    assert means == {"first": 0.5, "nulls": None, "second": 0.625, "neither": None}
    fixed = report(read_rows(spark, folder), score_source="strict_semantic_score")
    means = {r.source_file: r.similarity_mean for r in result_table(fixed, "by_model").collect()}
    assert means == {"first": 9.0, "nulls": 0.25, "second": 0.625, "neither": None}


def test_a_file_without_valid_rows(spark, write_lines):
    folder = write_lines(ok=['{"id":"en_1","model":"m"}'], bad=["{", ""], empty=[])
    with pytest.raises(ValueError, match="no valid rows"):
        stages.aggregate(spark, folder)
    results = stages.aggregate(spark, folder, on_empty="skip")
    assert {r.source_file for r in results.collect()} == {"ok"}


def test_a_file_with_only_missing_models_is_not_empty(spark, write_lines):
    folder = write_lines(ok=['{"id":"en_1","model":"m"}'], gap=['{"id":"en_1","model":null}'])
    assert {r.source_file for r in stages.aggregate(spark, folder).collect()} == {"ok"}


def test_csv_tables(spark, write_lines, tmp_path):
    lines = ['{"id":"en_02","model":"b","similarity":0.5,"LLMJudge result":"[Correct]"}', '{"id":"cn_01","model":"a"}']
    target = tmp_path / "out"
    stages.aggregate(spark, write_lines(run=lines), str(target))
    parts = sorted((target / "by_model_task" / "source_file=run_by_model_task").glob("part-*"))
    header = "model,task_type,n_total,similarity_mean,similarity_se,accuracy,accuracy_se"
    body = [line for p in parts for line in p.read_text().splitlines() if line != header]
    assert body == ["a,01,1.0,,,0.0,0.0", "b,02,1.0,0.5,0.0,1.0,0.0"]


def test_rows_of_a_csv_table_stand_in_order_over_many_parts_and_pieces(spark, tmp_path, monkeypatch):
    """A table cut into several part files, which are again read in small pieces, with a header line in each part."""
    rows = [(f"f{i % 2}", f"m{i * 7919 % 3000:04}", "en", f"en_{i:06}") for i in range(3000)]
    df = spark.createDataFrame(rows, "source_file string, model string, language string, id string")
    found = df.select("*", *(F.lit(1).alias(m) for m in catalog.MEASURES))

    def aggregate(spark, source, target, written):
        for name, keys in catalog.TABLES.items():
            table = found.withColumn("task_type", F.lit("01")) if name == "by_model_task" else found
            sinks.write_csv(table.select("source_file", *keys, *catalog.MEASURES), f"{target}/{name}", keys)

    monkeypatch.setattr(catalog.stages, "aggregate", aggregate)
    monkeypatch.setattr(catalog, "_noisy_folder", lambda *_: "")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [r for r in catalog._csv_order(spark, "").collect() if r.table == "by_model_language_id"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("f0", "f1"):
        placed = [(r.model, r.id) for r in sorted(got, key=lambda r: r.place) if r.source_file == name]
        assert placed == sorted((m, i) for f, m, _, i in rows if f == name)
        assert sorted(r.place for r in got if r.source_file == name) == list(range(1, len(placed) + 1))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_rows_are_read_once_and_never_expanded(spark, monkeypatch):
    df = spark.createDataFrame([("en_1", "m", "[Correct]", 1.0)], SCHEMA)
    written = []
    keep = report_module.materialise
    monkeypatch.setattr(report_module, "materialise", lambda groups, label: written.append(plan_of(groups)) or keep(groups, label))
    results = report(df)
    base, *rest = written
    assert base.count("Exchange") == 1 and "partial_avg" in base and "RDD" in base
    # All else is made of written groups.
    assert all("Expand" not in plan for plan in [*written, plan_of(results)])
    assert all("RDD" not in plan for plan in [*rest, plan_of(results)])


def test_keys_that_a_table_lacks_are_null(spark):
    for r in report(spark.createDataFrame([("en_01", "m", None, 1.0)], SCHEMA)).collect():
        own = {"by_model": "model", "by_model_language": "model language", "by_model_language_id": "model language id", "by_model_task": "model task_type"}
        assert [k for k in ("model", "language", "id", "task_type") if r[k] is not None] == own[r["table"]].split()


def test_groups_keep_their_precision_when_merged(spark):
    # The spread is a billionth of the values: sums of squares would lose it.
    values = [(f"en_{i % 50:02}", "m", None, 1e9 + (i % 7) * 1e-1 + (i % 50)) for i in range(3000)]
    table = groups(report(spark.createDataFrame(values, SCHEMA)), "by_model", ["model"])
    spread = statistics.stdev(v[3] for v in values) / math.sqrt(len(values))
    assert table[("m",)].similarity_se == pytest.approx(spread, rel=1e-6)
    assert table[("m",)].similarity_mean == pytest.approx(statistics.fmean(v[3] for v in values), rel=1e-15)


LENGTHS = Measure(
    initial=lambda score: {"longest": F.max(F.length("answer")), "kinds": F.bit_or(F.when(score > 1, 1).otherwise(2))},
    merge=lambda state: {"longest": F.max(state["longest"]), "kinds": F.bit_or(state["kinds"])},
    finish=lambda state: {"longest": state["longest"], "kinds": state["kinds"]},
)


def test_own_measures_over_any_columns(spark):
    rows = [("en_01", "m", 1.0, "a"), ("en_02", "m", 2.0, "bbb"), ("cn_02", "m", None, None), ("x", "n", 0.0, "cc")]
    df = spark.createDataFrame(rows, "id string, model string, similarity double, answer string")
    results = report(df, measures=[row_count(), LENGTHS])
    assert result_table(results, "by_model").columns == ["source_file", "model", "n_total", "longest", "kinds"]
    table = groups(results, "by_model", ["model"])
    assert (table[("m",)].longest, table[("m",)].kinds) == (3, 3)
    assert (table[("n",)].longest, table[("n",)].kinds) == (2, 2)
    task = groups(results, "by_model_task", ["model", "task_type"])
    assert (task[("m", "02")].n_total, task[("m", "02")].longest) == (2, 3)


def test_own_measures_follow_the_score_of_each_file(spark, write_lines):
    lines = ['{"id":"en_01","model":"m","similarity":5,"strict_semantic_score":9}', '{"id":"en_02","model":"m","similarity":7}']
    other = ['{"id":"en_01","model":"m","strict_semantic_score":3}']
    top = Measure(lambda score: {"top": F.max(score)}, lambda s: {"top": F.max(s["top"])}, lambda s: {"top": s["top"]})
    results = stages.aggregate(spark, write_lines(a=lines, b=other), measures=[top], count_unknown=True)
    found = {(r.source_file, r.top, r.n_unknown) for r in result_table(results, "by_model").collect()}
    assert found == {("a", 7.0, 2), ("b", 3.0, 1)}


def test_one_table_needs_no_expansion(spark):
    df = spark.createDataFrame([("en_1", "m", "[Correct]", 1.0)], SCHEMA)
    results = report(df, tables=["by_model"])
    assert "Expand" not in results._jdf.queryExecution().executedPlan().toString()
    assert results.columns == report(df).columns
    assert tuple(result_table(results, "by_model").first())[:3] == ("all", "m", 1)


def test_totals_agree_between_tables(spark):
    rows = spark.range(2000).select(
        F.concat(F.lit("en_"), F.lpad((F.col("id") % 37).cast("string"), 2, "0")).alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 5)).alias("model"),
        F.lit("[Correct]").alias("LLMJudge result"),
        F.col("id").cast("double").alias("similarity"),
    )
    results = report(rows)
    totals = {r["table"]: r.n for r in results.groupBy("table").agg(F.sum("n_total").alias("n")).collect()}
    assert set(totals.values()) == {2000} and len(totals) == 4
