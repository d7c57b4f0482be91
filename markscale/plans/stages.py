"""The five stages over JSON-lines files and folders, each one Spark job chain from scan to sink.

Rows keep every key they came with. Each function replaces what its output folder held before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markscale.functions import records as R
from markscale.functions.templates import ANSWER_TEMPLATE, JUDGE_TEMPLATE
from markscale.operators import model_jobs, prep, similarity
from markscale.operators.measures import Measure
from markscale.operators.report import (
    BY_FILE,
    STANDARD,
    TABLES,
    UNKNOWN_VERDICTS,
    choose_score,
    result_table,
    two_score_groups,
)
from markscale.session import materialise, release, scratch_path
from markscale.sources import sinks
from markscale.sources.jsonl import JSONL, list_files, read_records, read_rows

_ROW = ["source_file", "record"]


def filter_generations(spark: SparkSession, source: str, target: str) -> None:
    """Remove the fields of an earlier generation run from every row of a file."""
    rows = prep.drop_generation_fields(read_records(spark, source, pattern=None))
    sinks.write_records(rows, target, per_file=False)


def normalize_dataset(
    spark: SparkSession,
    source: str,
    target: str,
    *,
    drop_missing_language: bool = False,
    lowercase_language: bool = True,
) -> None:
    """Bring field names, language tags and ids of a file into their standard form."""
    rows = prep.normalize(
        read_records(spark, source, pattern=None),
        drop_missing=drop_missing_language,
        lowercase_language=lowercase_language,
    )
    sinks.write_records(rows, target, per_file=False)


def format_prompts(spark: SparkSession, source: str, target: str, template: str = ANSWER_TEMPLATE, **fields) -> None:
    """Attach the rendered prompt to every row of a file; ``fields`` as in ``prep.render_prompt``."""
    shown = [fields.get("text_field", "text"), fields.get("question_field", "question")]
    rows = prep.render_prompt(read_records(spark, source, pattern=None, printed=shown), template, printed=F.col("printed"), **fields)
    sinks.write_records(rows, target, per_file=False)


def infer(
    spark: SparkSession,
    source: str,
    target: str,
    failed: str,
    connect: model_jobs.Connect,
    params: model_jobs.CallParams,
    *,
    template: str = ANSWER_TEMPLATE,
    prompt_field: str | None = None,
    concurrency: int = 8,
    partitions: int | None = None,
    ledger: str | None = None,
    written: bool = False,
) -> None:
    """Answer every row of a file; rows whose call fails go to ``failed`` as they are.

    ``ledger`` is the path of a table that keeps all replies, so that a rerun asks only what is unanswered. Rows that only have a rendered prompt name its field in ``prompt_field``.
    """
    fields = [prompt_field] if prompt_field else ["text", "question"]
    rows = read_records(spark, source, blank_lines="error", pattern=None, written=written, printed=fields)
    record, printed = F.col("record"), F.col("printed")
    shown = [R.spelled(record, f, absent="None", null="None", printed=printed).alias(f"_{f}") for f in fields]
    if prompt_field:
        asked = rows.select(*_ROW, shown[0].alias("_prompt"))
        called = model_jobs.complete(
            asked, connect, params, prompt_col="_prompt", concurrency=concurrency, partitions=partitions, ledger=ledger
        )
    else:
        asked = rows.select(*_ROW, *shown)
        called = model_jobs.complete(
            asked,
            connect,
            params,
            template=template,
            text_col="_text",
            question_col="_question",
            concurrency=concurrency,
            partitions=partitions,
            ledger=ledger,
        )
    calls = scratch_path(spark, "calls")
    ok, lost = model_jobs.split_outcome(called.select(*_ROW, "answer", "model", "error"), _ROW, calls)
    answered = prep.extend_records(ok, {"answer": F.col("answer"), "model": F.col("model")})
    sinks.write_records(answered, target, per_file=False)
    sinks.write_records(lost, failed, per_file=False)
    release(spark, calls)


def score(
    spark: SparkSession,
    source: str,
    target: str,
    encoder: similarity.Encoder,
    *,
    chunker: similarity.Chunker = similarity.sentence_chunks,
    distinct_references: bool = False,
    pattern: str | None = JSONL,
    written: bool = False,
) -> None:
    """Add the similarity of answer and reference to every row of a folder, file by file."""
    rows = read_records(spark, source, blank_lines="error", pattern=pattern, written=written)
    record = F.col("record")
    texts = rows.select(
        *_ROW, R.text_value(record, "answer").alias("answer"), R.text_value(record, "reference").alias("reference")
    )
    scorer = similarity.score_distinct if distinct_references else similarity.score
    scored = scorer(texts, encoder, chunker=chunker)
    out = prep.extend_records(scored, {"similarity": F.col("similarity")})
    sinks.write_records(sinks.prefixed(out, sinks.SCORED_PREFIX), target)


def judge(
    spark: SparkSession,
    source: str,
    target: str,
    failed: str,
    connect: model_jobs.Connect,
    params: model_jobs.JudgeParams,
    *,
    template: str = JUDGE_TEMPLATE,
    concurrency: int = 8,
    partitions: int | None = None,
    ledger: str | None = None,
    pattern: str | None = JSONL,
    written: bool = False,
) -> None:
    """Add a verdict to every row of a folder; failed rows go to ``failed`` as they are."""
    fields = ("question", "answer", "reference")
    rows = read_records(spark, source, blank_lines="error", pattern=pattern, written=written, printed=fields)
    record, printed = F.col("record"), F.col("printed")
    asked = rows.select(
        *_ROW, *(R.spelled(record, f, absent="", null="None", printed=printed).alias(f"_{f}") for f in fields)
    )
    called = model_jobs.judge(
        asked,
        connect,
        params,
        template=template,
        question_col="_question",
        answer_col="_answer",
        reference_col="_reference",
        verdict_col="_verdict",
        concurrency=concurrency,
        partitions=partitions,
        ledger=ledger,
    )
    calls = scratch_path(spark, "calls")
    ok, lost = model_jobs.split_outcome(called.select(*_ROW, "_verdict", "error"), _ROW, calls)
    judged = prep.extend_records(ok, {model_jobs.JUDGE_COLUMN: F.col("_verdict")})
    sinks.write_records(sinks.prefixed(judged, sinks.JUDGED_PREFIX), target)
    sinks.write_records(sinks.prefixed(lost, sinks.FAILED_PREFIX), failed)
    release(spark, calls)


def aggregate(
    spark: SparkSession,
    source: str,
    target: str | None = None,
    *,
    on_empty: str = "error",
    measures: Sequence[Measure] = STANDARD,
    count_unknown: bool = False,
    pattern: str | None = JSONL,
    written: bool = False,
) -> DataFrame:
    """Report over every file of a folder, of any ``measures``; with ``target`` also as CSV tables.

    The tables of a file go to ``<target>/<table>/source_file=<file>_<table>``. A file without any
    valid row is an error, or is left out under ``on_empty="skip"``.
    """
    if on_empty not in ("error", "skip"):
        raise ValueError("on_empty is 'error' or 'skip'")
    rows = read_rows(spark, source, pattern=pattern, written=written)
    measures = [*measures, UNKNOWN_VERDICTS] if count_unknown else measures
    groups = two_score_groups(rows, measures)
    if on_empty == "error":
        seen = groups.filter(F.col("table") == BY_FILE).select("source_file")
        empty = list_files(spark, source, pattern=pattern, written=written).join(seen, "source_file", "left_anti")
        count, first = empty.agg(F.count("*"), F.min("source_file")).first()
        if count:
            raise ValueError(f"no valid rows in {count} files, the first of them {first!r}")
    results = choose_score(groups, measures)
    if target:
        results = materialise(results, "report")  # four sinks read it
        for name, keys in TABLES.items():
            table = result_table(results, name)
            named = table.withColumn("source_file", F.concat("source_file", F.lit(f"_{name}")))
            sinks.write_csv(named, f"{target.rstrip('/')}/{name}", keys)
    return results
