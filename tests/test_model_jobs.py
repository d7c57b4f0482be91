import json
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from markscale.operators import model_jobs
from markscale.operators.model_jobs import CallParams, JudgeParams, complete, judge, split_outcome
from markscale.operators.similarity import letter_encoder
from markscale.plans import stages
from markscale.sources.jsonl import read_lines

# Workers do not import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARAMS = CallParams(model="m1", system_prompt="sys")


def show_call():
    """Reply with everything the provider was given."""
    def call(messages, params):
        if "boom" in messages[-1]["content"]:
            raise RuntimeError("no")
        if "void" in messages[-1]["content"]:
            return None
        return json.dumps([messages, params.model, params.temperature, params.max_tokens])

    return call


def counting(path):
    """A provider that leaves one file per call."""
    def connect():
        import uuid
        from pathlib import Path

        def call(messages, params):
            (Path(path) / uuid.uuid4().hex).write_text(messages[-1]["content"])
            if "boom" in messages[-1]["content"]:
                raise RuntimeError("no")
            return " [Correct] \n"

        return call

    return connect


def test_model_stages_run_two_python_functions(spark, tmp_path, write_lines, monkeypatch):
    plans, split = [], model_jobs.split_outcome

    def watched(called, *more):
        plans.append(called._jdf.queryExecution().executedPlan().toString())
        return split(called, *more)

    monkeypatch.setattr(model_jobs, "split_outcome", watched)
    lines = ['{"text":["a",1.50],"question":{"k":null},"reference":[true],"prompt":[2]}', '{"text":"t","question":null,"reference":3}']
    folder, out = write_lines(a=lines), {name: str(tmp_path / name) for name in ("one", "two", "judged", "lost")}
    stages.infer(spark, f"{folder}/a.jsonl", f"{out['one']}/source_file=a", out["lost"], show_call, PARAMS, template="{text}/{problem}")
    stages.infer(spark, f"{folder}/a.jsonl", out["two"], out["lost"], show_call, PARAMS, prompt_field="prompt")
    stages.judge(spark, out["one"], out["judged"], out["lost"], show_call, JudgeParams(model="m2"), template="{question}|{reference}", written=True)
    # The parse and the calls: every further function is one more worker beside each busy core.
    assert [plan.count("ArrowEvalPython") for plan in plans] == [2, 2, 2]

    def prompts(path, key):
        found = [json.loads(r.line)[key] for r in read_lines(spark, path, pattern=None).collect()]
        return sorted(json.loads(reply)[0][-1]["content"] for reply in found)

    assert prompts(f"{out['one']}/source_file=a", "answer") == ["['a', 1.5]/{'k': None}", "t/None"]
    assert prompts(out["two"], "answer") == ["None", "[2]"]
    assert prompts(f"{out['judged']}/source_file=llmjudge_a", "LLMJudge result") == ["None|3", "{'k': None}|[True]"]


def rows(spark, *texts):
    data = [(i, t, "q") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "i int, text string, question string")


def test_messages_parameters_and_routing(spark):
    df = rows(spark, "a", "boom", None, "void")
    out = complete(df, show_call, PARAMS, template="{text}/{problem}", partitions=2)
    got = {r.i: r for r in out.collect()}
    messages = [{"role": "system", "content": "sys"}, {"role": "user", "content": "a/q"}]
    assert json.loads(got[0].answer) == [messages, "m1", 0.1, None]
    assert got[0].model == "m1" and got[0].error is None
    assert (got[1].answer, got[1].model, got[1].error) == (None, None, "RuntimeError: no")
    assert "None/q" in got[2].answer
    assert (got[3].answer, got[3].error, got[3].model) == (None, None, "m1")


def test_outcomes_partition_the_input(spark):
    df = rows(spark, "a", "boom", "b").withColumn("answer", F.lit("old"))
    ok, failed = split_outcome(complete(df, show_call, PARAMS), df.columns)
    assert {r.i for r in ok.collect()} == {0, 2}
    assert [tuple(r) for r in failed.collect()] == [(1, "boom", "q", "old")]
    assert failed.columns == df.columns and set(ok.columns) == {*df.columns, "model"}


def test_each_row_is_asked_once(spark, tmp_path):
    df = rows(spark, *(f"t{i} {'boom' if i % 4 == 0 else ''}" for i in range(20)))
    called = complete(df, counting(str(tmp_path)), PARAMS).filter(F.coalesce(F.col("answer"), F.lit("")) != "x")
    ok, failed = split_outcome(called, df.columns)
    assert ok.count() == 15 and failed.count() == 5 and ok.count() == 15
    assert len(list(tmp_path.iterdir())) == 20


def test_prompt_column_and_missing_columns(spark):
    df = spark.createDataFrame([("ready",)], "input string")
    out = complete(df, show_call, CallParams(model="m"), prompt_col="input").first()
    assert json.loads(out.answer)[0] == [{"role": "user", "content": "ready"}]
    with pytest.raises(ValueError, match="prompt_col"):
        complete(df, show_call, PARAMS)
    with pytest.raises(ValueError, match="reserved"):
        complete(df.withColumn("error", F.lit(1)), show_call, PARAMS, prompt_col="input")


def test_judge_strips_and_needs_a_reply(spark):
    def connect():
        replies = {"a": " [Correct]　\n", "b": None}

        def call(messages, params):
            assert (params.temperature, params.max_tokens) == (0.0, 4)
            return replies[messages[-1]["content"].split("|")[1]]

        return call

    df = spark.createDataFrame([(a, "r") for a in "abc"], "answer string, reference string")
    df = df.withColumn("question", F.lit("q"))
    out = judge(df, connect, JudgeParams(model="j"), template="{question}|{prediction}|{reference}", concurrency=1)
    got = {r.answer: r for r in out.collect()}
    assert (got["a"]["LLMJudge result"], got["a"].error) == ("[Correct]", None)
    assert got["b"]["LLMJudge result"] is None and got["b"].error == "empty reply"
    assert got["c"].error.startswith("KeyError")
    ok, failed = split_outcome(out.filter("answer <> 'c'"), df.columns)
    assert [r["LLMJudge result"] for r in ok.collect()] == ["[Correct]"]
    assert [r.answer for r in failed.collect()] == ["b"]


def test_only_messages_reach_python(spark):
    df = rows(spark, "a").withColumn("wide", F.lit("x"))
    plan = complete(df, show_call, PARAMS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_stages_over_files(spark, write_lines, tmp_path):
    """Answer, score, judge and report over files, with unknown keys and failures on the way."""
    lines = [
        {"id": "en_01", "text": "alpha beta。", "question": "what", "reference": "alpha。beta。", "keep": {"x": [1]}},
        {"id": "cn_02", "text": "boom", "question": "what", "reference": "gamma"},
        {"id": "cn_03", "question": None, "reference": ""},
    ]
    folder = write_lines(run=[json.dumps(line, ensure_ascii=False) for line in lines])
    out = {name: str(tmp_path / name) for name in ("answers", "failed", "scored", "judged", "judge_failed", "report")}
    stages.infer(
        spark, f"{folder}/run.jsonl", f"{out['answers']}/source_file=run", out["failed"], show_call, CallParams(model="m"),
        template="{text}-{problem}",
    )
    failed = [json.loads(r.line) for r in read_lines(spark, out["failed"], pattern=None).collect()]
    assert failed == [lines[1]]
    stages.score(spark, out["answers"], out["scored"], letter_encoder, written=True)
    stages.judge(
        spark, out["scored"], out["judged"], out["judge_failed"], reply_correct,
        JudgeParams(model="j"), written=True,
    )
    rows = read_lines(spark, out["judged"], written=True).collect()
    judged = {json.loads(r.line)["id"]: (r.source_file, json.loads(r.line)) for r in rows}
    name, first = judged["en_01"]
    assert name == "llmjudge_processed_run"
    assert list(first) == ["id", "text", "question", "reference", "keep", "answer", "model", "similarity", "LLMJudge result"]
    assert first["keep"] == {"x": [1]} and 0 < first["similarity"] <= 1
    assert "None-None" in judged["cn_03"][1]["answer"] and judged["cn_03"][1]["similarity"] is None
    report = stages.aggregate(spark, out["judged"], out["report"], written=True)
    row = report.filter("table = 'by_model'").first()
    assert (row.source_file, row.model, row.n_total, row.accuracy) == ("llmjudge_processed_run", "m", 2, 1.0)


def reply_correct():
    return lambda messages, params: "[Correct]"


def test_prep_stages_over_files(spark, write_lines, tmp_path):
    folder = write_lines(raw=['{",language":" ZH ","id":5,"model":"m","answer":"a","text":"t"}', "", '{"id":6}'])
    steps = [str(tmp_path / f"s{i}") for i in range(3)]
    stages.filter_generations(spark, f"{folder}/raw.jsonl", steps[0])
    stages.normalize_dataset(spark, steps[0], steps[1], drop_missing_language=True)
    stages.format_prompts(spark, steps[1], steps[2], "T:{text} Q:{problem}")
    lines = [r.line for r in read_lines(spark, steps[2], pattern=None).collect()]
    assert lines == ['{"id":"5","language":"cn","input":"T:t Q:"}']


def test_answers_can_come_from_a_rendered_prompt(spark, write_lines, tmp_path):
    folder = write_lines(raw=['{"id":"1","input":"ready"}'])
    target, failed = str(tmp_path / "o"), str(tmp_path / "f")
    stages.infer(
        spark, f"{folder}/raw.jsonl", target, failed, show_call, CallParams(model="m"), prompt_field="input"
    )
    line = json.loads(read_lines(spark, str(tmp_path / "o"), pattern=None).first().line)
    assert json.loads(line["answer"])[0] == [{"role": "user", "content": "ready"}]


def dying(path, calls):
    """A provider that takes its task down after so many calls."""
    connect = counting(path)

    def open_client():
        from pathlib import Path

        call = connect()

        def last(messages, params):
            if len(list(Path(path).iterdir())) >= calls:
                raise SystemExit("killed")
            return call(messages, params)

        return last

    return open_client


def test_a_rerun_asks_only_what_is_unanswered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(model_jobs, "WAVE_ROWS", 10)
    asked, ledger = tmp_path / "asked", str(tmp_path / "ledger")
    asked.mkdir()
    df = rows(spark, *(f"t{i % 40}" for i in range(60)))  # 40 requests, 20 of them twice
    with pytest.raises(Exception):
        complete(df, dying(str(asked), 25), PARAMS, concurrency=1, ledger=ledger)
    kept = model_jobs.read_ledger(spark, ledger).count()
    before = len(list(asked.iterdir()))
    assert 0 < kept <= before <= 26
    out = complete(df, counting(str(asked)), PARAMS, concurrency=1, ledger=ledger)
    assert out.columns == ["i", "text", "question", "error", "answer", "model"]
    assert {(r.answer, r.error) for r in out.collect()} == {(" [Correct] \n", None)} and out.count() == 60
    assert len(list(asked.iterdir())) == before + 40 - kept
    complete(df, counting(str(asked)), PARAMS, ledger=ledger).collect()
    assert len(list(asked.iterdir())) == before + 40 - kept
    # Other parameters are other requests.
    complete(df.limit(1), counting(str(asked)), CallParams(model="m2"), ledger=ledger).collect()
    assert len(list(asked.iterdir())) == before + 41 - kept


def test_failed_calls_are_asked_again_and_a_reply_stays(spark, tmp_path):
    ledger, flag = str(tmp_path / "ledger"), tmp_path / "well"
    path = str(flag)

    def connect():
        from pathlib import Path

        def call(messages, params):
            if "boom" in messages[-1]["content"] and not Path(path).exists():
                raise RuntimeError("no")
            return "yes"

        return call

    df = rows(spark, "a", "boom", "boom")
    first = complete(df, connect, PARAMS, ledger=ledger).orderBy("i").collect()
    assert [(r.answer, r.error) for r in first] == [("yes", None), (None, "RuntimeError: no"), (None, "RuntimeError: no")]
    flag.touch()
    again = complete(df, connect, PARAMS, ledger=ledger).collect()
    assert {(r.answer, r.error) for r in again} == {("yes", None)}
    assert complete(df.where("false"), connect, PARAMS, ledger=ledger).count() == 0


def test_replies_leave_in_small_batches_and_in_order(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(model_jobs, "REPLY_CHARS", 1000)
    keep = model_jobs._reply_rows
    monkeypatch.setattr(model_jobs, "_reply_rows", lambda replies: sizes.append(len(replies)) or keep(replies))
    monkeypatch.setattr(model_jobs.F, "arrow_udf", lambda function, kind: type("Plain", (), {"asNondeterministic": lambda self: function})())
    ask = model_jobs._caller(lambda: lambda messages, params: messages[0]["content"] * 300, PARAMS, 4)
    kind = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))
    batches = [pa.array([[{"role": "user", "content": str(n)}] for n in range(low, low + 50)], kind) for low in (0, 50, 100)]
    replies = [r["reply"] for batch in ask(iter(batches)) for r in batch.to_pylist()]
    assert replies == [str(n) * 300 for n in range(150)]
    # Only the last one also has the calls that were still under way.
    assert max(sizes[:-1]) <= 4 and sizes[-1] <= 8 and sum(sizes) == 150


def test_stages_with_a_ledger(spark, write_lines, tmp_path):
    source = write_lines(a=['{"id":"1","text":"t","question":"q"}', '{"id":"2","text":"boom","question":"q"}'])
    for name in ("one", "two"):
        stages.infer(
            spark, f"{source}/a.jsonl", str(tmp_path / name), str(tmp_path / f"{name}_failed"), counting(str(tmp_path)), PARAMS, ledger=str(tmp_path / "calls")
        )
        assert read_lines(spark, str(tmp_path / name), pattern=None).count() == 1
        assert read_lines(spark, str(tmp_path / f"{name}_failed"), pattern=None).count() == 1
    # The failed call was made twice, the other once.
    assert sum(p.is_file() and len(p.name) == 32 for p in tmp_path.iterdir()) == 3
