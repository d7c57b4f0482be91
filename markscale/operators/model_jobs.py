"""Model calls as partitioned jobs: batch completion and answer judging.

Only the messages travel to the Python workers and only the replies come back; every other column
stays in the JVM. A row whose call fails carries the reason in ``error`` and never stops the job.
"""

from __future__ import annotations

import json
import time
import warnings
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markscale.functions.templates import ANSWER_TEMPLATE, JUDGE_TEMPLATE, chat_messages
from markscale.functions.text import strip
from markscale.operators.prompts import answer_prompt, judge_prompt
from markscale.operators.skew import lookup_join
from markscale.session import materialise

JUDGE_COLUMN = "LLMJudge result"

_REPLY = "reply string, error string"


@dataclass(frozen=True)
class CallParams:
    """What a provider gets with every call."""

    model: str
    temperature: float = 0.1
    max_tokens: int | None = None
    system_prompt: str | None = None


@dataclass(frozen=True)
class JudgeParams(CallParams):
    temperature: float = 0.0
    max_tokens: int | None = 4


# ``connect()`` runs once per task and returns ``call(messages, params) -> reply or None``. The
# messages are ``{"role": .., "content": ..}`` dicts; an exception marks the row as failed.
Connect = Callable[[], Callable[[list[dict], CallParams], str | None]]


#: Replies go back to the JVM when so many, or so many characters of them, are there.
REPLY_ROWS, REPLY_CHARS = 64, 1 << 20
#: Requests that a wave of the ledger asks between two commits.
WAVE_ROWS = 10_000


def _caller(connect: Connect, params: CallParams, concurrency: int) -> Callable[[Column], Column]:
    def ask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = connect()

        def one(messages):
            try:
                return call([dict(m) for m in messages], params), None
            except Exception as failure:
                return None, f"{type(failure).__name__}: {failure}"

        # Only the messages whose calls are under way are Python objects, whatever an Arrow batch holds.
        requests = (value.as_py() for batch in batches for value in batch)
        with ThreadPoolExecutor(max_workers=concurrency) as threads:
            under_way, replies, size = deque(), [], 0
            for messages in requests:
                under_way.append(threads.submit(one, messages))
                if len(under_way) <= concurrency:
                    continue
                replies.append(under_way.popleft().result())
                size += sum(map(len, filter(None, replies[-1])))
                if len(replies) >= REPLY_ROWS or size >= REPLY_CHARS:
                    yield _reply_rows(replies)
                    replies, size = [], 0
            replies += [future.result() for future in under_way]
            if replies:
                yield _reply_rows(replies)

    # Declared non-deterministic, so that the optimizer never runs a call twice.
    return F.arrow_udf(ask, _REPLY).asNondeterministic()


def _reply_rows(replies: list[tuple[str | None, str | None]]) -> pa.Array:
    return pa.array([{"reply": reply, "error": error} for reply, error in replies], pa.struct([("reply", pa.string()), ("error", pa.string())]))


def call_model(
    df: DataFrame,
    prompt: Column,
    connect: Connect,
    params: CallParams,
    *,
    concurrency: int = 8,
    partitions: int | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """Add ``_reply`` and ``error``. At most ``concurrency`` calls run at once in each task.

    ``partitions`` spreads few or small input files over that many tasks at the price of a
    shuffle; by default the partitioning of the scan is kept. ``ledger`` is the path of a table that keeps
    every reply, see :func:`call_once`.
    """
    if "error" in df.columns:
        raise ValueError("the column 'error' is reserved for the reason of a failed call")
    if df.sparkSession.conf.get("spark.speculation", "false") == "true":
        warnings.warn("speculative tasks repeat model calls; turn spark.speculation off", stacklevel=3)
    messages = chat_messages(prompt, params.system_prompt)
    if ledger:
        return call_once(df, messages, connect, params, ledger, concurrency=concurrency, partitions=partitions)
    if partitions:
        df = df.repartition(partitions)
    called = df.withColumn("_call", _caller(connect, params, concurrency)(messages))
    return called.select(
        *(F.col(f"`{name}`") for name in df.columns),
        F.col("_call.reply").alias("_reply"),
        F.col("_call.error").alias("error"),
    )


def request_digest(messages: Column, params: CallParams) -> Column:
    """What identifies a request: the messages and all that the provider gets with them."""
    settings = json.dumps(asdict(params), sort_keys=True)
    return F.sha2(F.concat_ws("\n", F.lit(settings), F.to_json(messages)), 256)


LEDGER = "digest string, reply string, error string, asked long"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All calls that were recorded at ``path``, failed ones too."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def call_once(
    df: DataFrame,
    messages: Column,
    connect: Connect,
    params: CallParams,
    ledger: str,
    *,
    concurrency: int = 8,
    partitions: int | None = None,
    wave_rows: int | None = None,
) -> DataFrame:
    """Add ``_reply`` and ``error`` from the ledger, after asking what it does not answer yet.

    Requests are distinct messages and parameters: rows that ask the same share one reply. They are asked in waves of
    about ``wave_rows``, and every wave is appended to the ledger when it is done. A run that was killed, or a later one over
    more rows, asks only requests without a reply; what is lost is at most one wave. Failed calls are
    recorded too, and asked again by the next run. The calls are made when this is called.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_digest", request_digest(messages, params))
    requests = keyed.groupBy("_digest").agg(F.first(messages).alias("_messages"), F.count(F.lit(1)).alias("_rows"))
    requests = materialise(requests, "requests")
    answered = read_ledger(spark, ledger).where(F.col("reply").isNotNull()).select(F.col("digest").alias("_digest"))
    open_requests = materialise(requests.join(answered, "_digest", "left_anti"), "open-requests")
    waves = -(-open_requests.count() // (wave_rows or WAVE_ROWS))
    ask = _caller(connect, params, concurrency)
    for wave in range(waves):
        todo = open_requests.where(F.pmod(F.xxhash64("_digest"), F.lit(waves)) == wave)
        called = (todo.repartition(partitions) if partitions else todo).withColumn("_call", ask("_messages"))
        rows = called.select(F.col("_digest").alias("digest"), "_call.reply", "_call.error", F.lit(time.time_ns()).alias("asked"))
        rows.write.mode("append").parquet(ledger)
    # A reply counts before any failure, else the last call.
    rank = F.struct(F.col("reply").isNotNull().cast("int"), F.col("asked"))
    known = read_ledger(spark, ledger).groupBy(F.col("digest").alias("_digest")).agg(F.max_by(F.struct("reply", "error"), rank).alias("_call"))
    replies = materialise(requests.select("_digest", "_rows").join(known, "_digest"), "replies")
    joined = lookup_join(keyed, replies, "_digest", "_rows")
    return joined.select(
        *(F.col(f"`{name}`") for name in df.columns), F.col("_call.reply").alias("_reply"), F.col("_call.error").alias("error")
    )


def _if_ok(df: DataFrame, name: str, value: Column) -> Column:
    """``value`` for answered rows; failed rows keep what the column held before the call."""
    before = F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")
    return F.when(F.col("error").isNull(), value).otherwise(before)


def complete(
    df: DataFrame,
    connect: Connect,
    params: CallParams,
    *,
    template: str = ANSWER_TEMPLATE,
    text_col: str = "text",
    question_col: str = "question",
    prompt_col: str | None = None,
    concurrency: int = 8,
    partitions: int | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """Ask for one answer per row: adds ``answer``, ``model`` and ``error``.

    The prompt is rendered from text and question, or taken as it is from ``prompt_col``. A reply
    without content is an answer, not a failure.
    """
    if prompt_col:
        prompt = F.col(prompt_col)
    else:
        missing = [c for c in (text_col, question_col) if c not in df.columns]
        if missing:
            raise ValueError(f"no column {missing}; rows with a rendered prompt need prompt_col")
        prompt = answer_prompt(F.col(text_col), F.col(question_col), template)
    called = call_model(df, prompt, connect, params, concurrency=concurrency, partitions=partitions, ledger=ledger)
    return called.withColumns(
        {
            "answer": _if_ok(df, "answer", F.col("_reply")),
            "model": _if_ok(df, "model", F.lit(params.model)),
        }
    ).drop("_reply")


def judge(
    df: DataFrame,
    connect: Connect,
    params: JudgeParams,
    *,
    template: str = JUDGE_TEMPLATE,
    question_col: str = "question",
    answer_col: str = "answer",
    reference_col: str = "reference",
    verdict_col: str = JUDGE_COLUMN,
    concurrency: int = 8,
    partitions: int | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """Ask for one verdict per row: adds ``verdict_col`` and ``error``.

    The verdict is stripped, and a row without a reply counts as failed.
    """
    prompt = judge_prompt(F.col(question_col), F.col(answer_col), F.col(reference_col), template)
    called = call_model(df, prompt, connect, params, concurrency=concurrency, partitions=partitions, ledger=ledger)
    no_reply = F.when(F.col("_reply").isNull(), F.lit("empty reply"))
    return (
        called.withColumn("error", F.coalesce(F.col("error"), no_reply))
        .withColumn(verdict_col, _if_ok(df, verdict_col, strip(F.col("_reply"))))
        .drop("_reply")
    )


def split_outcome(
    df: DataFrame, input_columns: list[str], path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Run the calls behind ``df`` once, and return the rows that succeeded and that failed.

    The combined table is written first (to ``path`` or the shared scratch folder), partitioned by
    outcome, and each result reads its own part, so no call is repeated or answered differently.
    Failed rows come back as they went in, with ``input_columns`` only. Once both are stored, the
    caller may ``release`` a ``path`` of its own.
    """
    table = materialise(df.withColumn("_failed", F.col("error").isNotNull()), "calls", path, ("_failed",))
    ok = table.filter(~F.col("_failed")).drop("error", "_failed")
    failed = table.filter("_failed")
    return ok, failed.select(*(F.col(f"`{name}`") for name in input_columns))
