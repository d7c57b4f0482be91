"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markscale.functions import records as R
from markscale.functions.chunks import packed_chunks, sentence_chunks
from markscale.functions.fields import (
    is_correct,
    language_from_id,
    score_from_text,
    task_from_id,
    verdict_label,
)
from markscale.functions.templates import chat_messages
from markscale.operators import model_jobs, prep, prompts, similarity
from markscale.operators.measures import Measure
from markscale.operators.report import MEASURES, STANDARD, TABLES, report, result_table
from markscale.plans import stages, stubs, views
from markscale.session import deal, materialise, scratch_path
from markscale.sources import sinks
from markscale.sources.jsonl import list_files, parse_records, read_records, read_rows

Query = Callable[[SparkSession, str], DataFrame]

ANSWER = "T: {text}\nQ: {problem} {{end}}"
JUDGE = "Q: {question}\nA: {prediction}\nR: {reference}\nVerdict:"
SHORT = "S: {text}\nQ: {problem}"
SYSTEM = "Be brief."
STOP = "."
PACK_LIMIT = 200
DIMENSIONS = 64


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def _hashed(df: DataFrame, *names: str) -> DataFrame:
    """Replace long texts by their digest, which depends on all of the text."""
    return df.withColumns({name: F.md5(F.col(name)) for name in names})


# Report ---------------------------------------------------------------------------------------

FLOATS = [m for m in MEASURES if m != "n_total"]


def _eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(spark, sf_dir, views.EVAL_ROWS)


def _eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _eval_rows(spark, sf_dir).withColumnRenamed("sim", "similarity")
    return _rounded(report(rows, judge_col="judge"), *FLOATS).drop("source_file")


def _one_table(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _eval_rows(spark, sf_dir).withColumnRenamed("sim", "similarity")
        results = report(rows, judge_col="judge", tables=[name])
        return _rounded(result_table(results, name), *FLOATS).drop("source_file")

    return query


def _lineitem_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.view(spark, sf_dir, views.LINE_ROWS, "lineitem").withColumnRenamed("sim", "similarity")
    return _rounded(report(rows, judge_col="judge"), *FLOATS).drop("source_file")


def _unknown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _eval_rows(spark, sf_dir).withColumnRenamed("sim", "similarity")
    results = report(rows, judge_col="judge", tables=["by_model"], count_unknown=True)
    return result_table(results, "by_model").select("model", "n_total", "n_unknown")


#: A measure that the library does not ship: how far scores reach, and how many reach one.
REACH = Measure(
    initial=lambda score: {"low": F.min(score), "top": F.max(score), "high": F.count_if(score >= 1), "n": F.count(score)},
    merge=lambda s: {"low": F.min(s["low"]), "top": F.max(s["top"]), "high": F.sum(s["high"]), "n": F.sum(s["n"])},
    finish=lambda s: {"score_range": s["top"] - s["low"], "high_share": s["high"] / F.nullif(s["n"], F.lit(0))},
)


def _own_measures_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _eval_rows(spark, sf_dir).withColumnRenamed("sim", "similarity")
    results = report(rows, judge_col="judge", measures=[*STANDARD, REACH])
    return _rounded(results, *FLOATS, "score_range", "high_share").drop("source_file")


# Fields ---------------------------------------------------------------------------------------


def _field(source: str, name: str, expression: Callable[[Column], Column]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _eval_rows(spark, sf_dir).select("doc_id", expression(F.col(source)).alias(name))

    return query


def _score_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_field("sim", "score", score_from_text)(spark, sf_dir), "score")


# Preparation ----------------------------------------------------------------------------------


def _edited(edit: Callable[[DataFrame], DataFrame]) -> Query:
    """The rows after an edit: their keys in order, id and language as JSON, and the text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = edit(parse_records(views.raw_lines(spark, sf_dir)))
        record = F.col("record")

        def shown(key: str) -> Column:
            return record[key]

        return rows.select(
            shown("doc").cast("bigint").alias("doc_id"),
            F.array_join(F.map_keys(record), "|").alias("key_list"),
            shown("id").alias("id"),
            shown("language").alias("language"),
            F.md5(R.text_value(record, "text")).alias("text_md5"),
        )

    return query


def _normalize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.normalize_columns(views.view(spark, sf_dir, views.TAGGED_ROWS), drop_missing=True)
    return _hashed(rows, "text")


# Prompts --------------------------------------------------------------------------------------


def _prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(spark, sf_dir, views.PROMPT_ROWS)


def _prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(prompts.with_prompt(_prompt_rows(spark, sf_dir), ANSWER), "input")


def _prompt_render_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prompts.with_prompt(
        _prompt_rows(spark, sf_dir), ANSWER, target_col="question", drop_source_cols=False
    )
    return _hashed(rows, "text", "question")


def _prompt_render_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_records(views.raw_lines(spark, sf_dir), printed=("text", "id"))
    rows = prep.render_prompt(parsed, ANSWER, question_field="id", printed=F.col("printed"))
    record = F.col("record")
    return rows.select(
        record["doc"].cast("bigint").alias("doc_id"),
        F.array_join(F.map_keys(record), "|").alias("key_list"),
        F.md5(R.text_value(record, "input")).alias("input"),
    )


def _answer_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = prompts.answer_prompt(F.col("text"), F.col("question"), ANSWER)
    return _hashed(_prompt_rows(spark, sf_dir).select("doc_id", prompt.alias("prompt")), "prompt")


def _qa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deal(views.view(spark, sf_dir, views.QA_ROWS))


def _judge_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = prompts.judge_prompt(F.col("question"), F.col("answer"), F.col("reference"), JUDGE)
    return _hashed(_qa_rows(spark, sf_dir).select("conv_id", "turn", prompt.alias("prompt")), "prompt")


def _chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    system = F.coalesce("instruction", F.lit(SYSTEM))
    messages = F.explode(chat_messages(F.col("question"), system)).alias("m")
    return deal(views.view(spark, sf_dir, views.SYSTEM_ROWS)).select("conv_id", "turn", messages).select("conv_id", "turn", "m.role", "m.content")


# Similarity -----------------------------------------------------------------------------------


def _chunks(chunker: Callable[[Column], Column]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents = deal(views.table(spark, sf_dir, "documents"))
        chunks = documents.select("doc_id", chunker(F.col("text")).alias("c"))
        return chunks.select(
            "doc_id",
            F.size("c").cast("bigint").alias("n_chunks"),
            F.md5(F.array_join("c", "|")).alias("chunks_md5"),
        )

    return query


def _stop_chunks(text: Column) -> Column:
    return sentence_chunks(text, STOP)


def _packed_chunks(text: Column) -> Column:
    return packed_chunks(text, STOP, PACK_LIMIT)


def _cosine_matrix_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = views.table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("g"), (F.col("vec_id") % 2).alias("side"), "embedding"
    )
    groups = similarity.set_similarity(vectors, ["g"], F.col("side"), "embedding", DIMENSIONS)
    return _rounded(groups, "similarity")


def _similarity(scorer, chunker: Callable[[Column], Column] = _stop_chunks) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = scorer(_qa_rows(spark, sf_dir), similarity.letter_encoder, chunker=chunker)
        return _rounded(scored.select("conv_id", "turn", "similarity"), "similarity")

    return query


# Model jobs -----------------------------------------------------------------------------------


def _completions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _qa_rows(spark, sf_dir).select("conv_id", "turn", F.col("reference").alias("text"), "question")
    params = model_jobs.CallParams(model="stub-1", system_prompt=SYSTEM)
    called = model_jobs.complete(rows, stubs.completion_endpoint, params, template=ANSWER, concurrency=1)
    return model_jobs.split_outcome(called, rows.columns)


def _completion(outcome: int) -> Query:
    return lambda spark, sf_dir: _hashed(_completions(spark, sf_dir)[outcome], "text")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the even conversations, then one over all rows, which asks only what the first did not."""
    rows = _qa_rows(spark, sf_dir).select("conv_id", "turn", F.col("reference").alias("text"), "question")
    params = model_jobs.CallParams(model="stub-1", system_prompt=SYSTEM)
    path = scratch_path(spark, "ledger")

    def run(part: DataFrame) -> DataFrame:
        return model_jobs.complete(part, stubs.completion_endpoint, params, template=ANSWER, concurrency=1, ledger=path)

    run(rows.where("conv_id % 2 = 0"))
    return run(rows).select("conv_id", "turn", "answer", F.col("error").isNotNull().alias("failed"))


def _verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _qa_rows(spark, sf_dir)
    called = model_jobs.judge(
        rows, stubs.judge_endpoint, model_jobs.JudgeParams(model="stub-2"), template=JUDGE, concurrency=1
    )
    return model_jobs.split_outcome(called.withColumnRenamed(model_jobs.JUDGE_COLUMN, "judge_raw"), rows.columns)


def _verdict(outcome: int) -> Query:
    return lambda spark, sf_dir: _hashed(_verdicts(spark, sf_dir)[outcome], "question", "answer", "reference")


# Sources and sinks ----------------------------------------------------------------------------


def _jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the rows as files with blank lines, read them strictly, write and read them again."""
    lines = views.raw_lines(spark, sf_dir)
    padded = lines.select("source_file", F.explode(F.array("line", F.lit(" 　\t"))).alias("line"))
    first = read_records(spark, views.write_lines(padded, "strict"), written=True)
    path = scratch_path(spark, "strict-copy")
    sinks.write_records(sinks.prefixed(first, sinks.SCORED_PREFIX), path)
    record = F.col("record")
    return read_records(spark, path, blank_lines="error", written=True).select(
        "source_file",
        record["doc"].cast("bigint").alias("doc_id"),
        F.array_join(F.map_keys(record), "|").alias("key_list"),
        F.md5(R.text_value(record, "text")).alias("text_md5"),
    )


def _noisy_folder(spark: SparkSession, sf_dir: str, label: str) -> str:
    return views.write_lines(views.with_noise(views.judged_lines(spark, sf_dir)), label)


def _jsonl_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_rows(spark, _noisy_folder(spark, sf_dir, "lenient"), written=True)
    return rows.select(
        "source_file",
        "id",
        "model",
        F.col("`LLMJudge result`").alias("judge"),
        F.col("similarity").isNotNull().alias("has_similarity"),
        F.try_variant_get("similarity", "$", "string").alias("sim"),
        F.try_variant_get("strict_semantic_score", "$", "string").alias("fallback"),
    )


def _folder_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = stages.aggregate(spark, _noisy_folder(spark, sf_dir, "report"), written=True)
    return _rounded(results, *FLOATS)


def _plain_folder_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over a folder of plain files, each of a language and a million documents, and the files without a row."""
    judged = views.judged_lines(spark, sf_dir)
    named = F.concat("source_file", F.lit("_"), F.expr("doc_id div 1000000").cast("string"))
    rows = views.with_noise(judged.withColumn("source_file", named))
    path = scratch_path(spark, "plain-in")
    sinks.write_plain(rows, path, files=spark.createDataFrame([("nothing",)], "source_file string"))
    results = _rounded(stages.aggregate(spark, path, on_empty="skip"), *FLOATS)
    empty = list_files(spark, path).join(results.select("source_file").distinct(), "source_file", "left_anti")
    return results.unionByName(empty.withColumn("table", F.lit("no rows")), allowMissingColumns=True)


def _csv_tables(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """The four CSV tables of every file, read back as text fields beside the path and first byte of what a task read."""
    target = scratch_path(spark, label)
    stages.aggregate(spark, _noisy_folder(spark, sf_dir, f"{label}-in"), target, written=True)

    def back(name: str) -> DataFrame:
        schema = ", ".join(f"{c} string" for c in [*TABLES[name], *MEASURES, "source_file"])
        rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{target}/{name}")
        spot = {"part": F.col("_metadata.file_path"), "first_byte": F.col("_metadata.file_block_start")}
        return rows.withColumns({"table": F.lit(name), **spot})

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(back, TABLES))


def _csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _csv_tables(spark, sf_dir, "csv").drop("part", "first_byte")
    return tables.withColumns({m: F.round(F.col(m).cast("double"), 6) for m in FLOATS})


def _csv_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of every row of the CSV tables and its place, counted from 1, in its file's table.

    Parts follow each other by name. Rows are numbered within the piece of a part that a task read, pieces by the rows before them.
    """
    block = ["table", "source_file", "part", "first_byte"]
    keys = ["model", "language", "id", "task_type"]
    # Numbers rise within a piece; written, so that they are drawn once.
    numbered = _csv_tables(spark, sf_dir, "csv-order").select(*block, *keys, F.monotonically_increasing_id().alias("n"))
    rows = materialise(numbered, "csv-rows")
    pieces = rows.groupBy(*block).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("table", "source_file").orderBy("part", "first_byte").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("least") + 1)
    placed = rows.join(starts.drop("least", "rows"), block)
    return placed.select("source_file", "table", *keys, (F.col("n") + F.col("start")).alias("place"))


# The whole evaluation ---------------------------------------------------------------------------


def _evaluate(spark: SparkSession, sf_dir: str) -> str:
    """Complete, score and judge, with each stage reading the files of the one before; the folder of all files."""
    qa = _qa_rows(spark, sf_dir)
    item = F.concat(
        F.when(F.col("conv_id") % 2 == 0, F.lit("EN_")).otherwise(F.lit("cn_")),
        F.lpad((F.col("turn") % 100).cast("string"), 2, "0"),
    )
    rows = qa.select(
        item.alias("id"), F.col("reference").alias("text"), "question", "reference", F.lit(7).alias("extra")
    )
    root = scratch_path(spark, "evaluation")
    sinks.write_rows(rows, f"{root}/rows", per_file=False)
    stages.infer(
        spark,
        f"{root}/rows",
        f"{root}/answers/source_file=answers",
        f"{root}/answers_failed",
        stubs.echo_endpoint,
        model_jobs.CallParams(model="stub-1"),
        template=SHORT,
        concurrency=1,
    )
    stages.score(
        spark,
        f"{root}/answers",
        f"{root}/scored",
        similarity.letter_encoder,
        chunker=_stop_chunks,
        written=True,
    )
    stages.judge(
        spark,
        f"{root}/scored",
        f"{root}/judged",
        f"{root}/judged_failed",
        stubs.judge_endpoint,
        model_jobs.JudgeParams(model="stub-2"),
        template=JUDGE,
        concurrency=1,
        written=True,
    )
    return root


def _evaluation_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _evaluate(spark, sf_dir)
    return _rounded(stages.aggregate(spark, f"{root}/judged", written=True), *FLOATS)


def _evaluation_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the two model stages lost, read back from their own outputs."""
    root = _evaluate(spark, sf_dir)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "question", "answer", "reference")])

    def lost(stage: str, folder: str, **options) -> DataFrame:
        rows = read_rows(spark, f"{root}/{folder}", schema, strict=True, blank_lines="error", **options)
        return _hashed(rows.select(F.lit(stage).alias("stage"), *schema.names), "question", "answer", "reference")

    return lost("infer", "answers_failed", pattern=None).unionByName(lost("judge", "judged_failed", written=True))


QUERIES: dict[str, Query] = {
    "report_by_model": _one_table("by_model"),
    "report_by_model_language": _one_table("by_model_language"),
    "report_by_model_language_id": _one_table("by_model_language_id"),
    "report_by_model_task": _one_table("by_model_task"),
    "report_all": _eval_report,
    "report_all_lineitem": _lineitem_report,
    "report_unknown_verdicts": _unknown_report,
    "report_own_measures": _own_measures_report,
    "verdict_label": _field("judge", "llm_label", verdict_label),
    "correct_flag": _field("judge", "is_correct", lambda c: is_correct(verdict_label(c))),
    "language_from_id": _field("id", "language", language_from_id),
    "task_from_id": _field("id", "task_type", task_from_id),
    "score_coerce": _score_coerce,
    "drop_generation_fields": _edited(prep.drop_generation_fields),
    "legacy_language": _edited(prep.rename_legacy_language),
    "language_canonical": _edited(prep.canonicalise_language),
    "language_canonical_case_kept": _edited(lambda df: prep.canonicalise_language(df, lowercase=False)),
    "id_normalize": _edited(prep.stringify_id),
    "drop_missing_language": _edited(prep.drop_missing_language),
    "normalize_dataset": _edited(lambda df: prep.normalize(df, drop_missing=True)),
    "normalize_columns": _normalize_columns,
    "prompt_render": _prompt_render,
    "prompt_render_keep": _prompt_render_keep,
    "prompt_render_records": _prompt_render_records,
    "answer_prompt": _answer_prompt,
    "judge_prompt": _judge_prompt,
    "chat_messages": _chat_messages,
    "chunk_sentences": _chunks(_stop_chunks),
    "chunk_packed": _chunks(_packed_chunks),
    "cosine_matrix_mean": _cosine_matrix_mean,
    "similarity_score": _similarity(similarity.score),
    "similarity_score_distinct": _similarity(similarity.score_distinct),
    "similarity_score_packed": _similarity(similarity.score, _packed_chunks),
    "similarity_score_distinct_packed": _similarity(similarity.score_distinct, _packed_chunks),
    "batch_completion_ok": _completion(0),
    "batch_completion_failed": _completion(1),
    "batch_completion_ledger": _ledger,
    "judge_ok": _verdict(0),
    "judge_failed": _verdict(1),
    "jsonl_strict": _jsonl_strict,
    "jsonl_lenient": _jsonl_lenient,
    "folder_report": _folder_report,
    "plain_folder_report": _plain_folder_report,
    "csv_report": _csv_report,
    "csv_order": _csv_order,
    "evaluation_end_to_end": _evaluation_end_to_end,
    "evaluation_failed": _evaluation_failed,
}
