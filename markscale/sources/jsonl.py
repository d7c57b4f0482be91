"""JSON-lines scans: files, folders and globs, strict or lenient, as records or typed columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markscale.functions.records import record_and_printed, record_of
from markscale.functions.text import is_visible, let

JSONL = "*.jsonl"
#: A folder beside the data, which scans step over, with the rows and bytes of every file.
MANIFEST, MANIFEST_TYPE = "_manifest", "source_file string, rows long, bytes long"

# Scores stay variants, so that JSON booleans, quoted numbers and absent keys can be told apart.
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("LLMJudge result", T.StringType()),
        T.StructField("similarity", T.VariantType()),
        T.StructField("strict_semantic_score", T.VariantType()),
    ]
)

# The parser's own limits are lifted: a text may be as long as Spark can hold, and the typed scan steps over
# what it does not read, however deep.
_NO_LIMIT = str((1 << 31) - 1)
_JSON_RULES = {"allowSingleQuotes": "false", "maxStringLen": _NO_LIMIT, "maxNumLen": _NO_LIMIT, "maxNestingDepth": _NO_LIMIT}
_GUARD = "\u0001end"
_GUARD_JSON = r'{"\u0001end":"1"}'


def read_lines(spark: SparkSession, path: str, *, pattern: str | None = JSONL, written: bool = False) -> DataFrame:
    """Lines as ``(source_file, line)``, where ``source_file`` is the file name without ``.jsonl``.

    ``path`` is a folder (its files that match ``pattern``, one level deep), a file, or a glob.
    Pass ``pattern=None`` to take a file whatever its name is. ``written=True`` reads a folder
    that one of the sinks wrote.
    """
    if written:
        return spark.read.schema("line string, source_file string").text(path).select("source_file", "line")
    return named_lines(spark.read, path, pattern)


def named_lines(reader, path: str, pattern: str | None) -> DataFrame:
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    # The name stands there as in a URI, where a plus sign is itself.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    stem = F.regexp_replace(name, r"[.]jsonl$", "")
    return reader.text(path).select(stem.alias("source_file"), F.col("value").alias("line"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """``source_file``, ``rows``, ``bytes`` of a folder whose sink left a manifest."""
    try:
        return spark.read.schema(MANIFEST_TYPE).parquet(f"{path.rstrip('/')}/{MANIFEST}")
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def list_files(spark: SparkSession, path: str, *, pattern: str | None = JSONL, written: bool = False) -> DataFrame:
    """``source_file`` of every file that :func:`read_lines` would read, even an empty one.

    The names come from the folder's manifest if it has one. Else they are those of the file index that Spark keeps on the
    driver for every scan; no file is opened. (A listing by tasks would not do: Spark's scans skip empty files.)
    """
    manifest = read_manifest(spark, path) if pattern == JSONL else None
    if manifest is not None:
        return manifest.select("source_file")
    paths = [unquote(uri) for uri in read_lines(spark, path, pattern=pattern, written=written).inputFiles()]
    if written:
        folders = (re.search(r"/source_file=([^/]*)/", p) for p in paths)
        names = {unquote(folder.group(1)) for folder in folders if folder}
    else:
        names = {p.rsplit("/", 1)[-1].removesuffix(".jsonl") for p in paths}
    return spark.createDataFrame(pa.table({"source_file": pa.array(sorted(names), pa.string())}))


def read_records(
    spark: SparkSession,
    path: str,
    *,
    blank_lines: str = "skip",
    pattern: str | None = JSONL,
    written: bool = False,
    printed: Sequence[str] = (),
) -> DataFrame:
    """Strict scan of open-schema rows as ``(source_file, line, record)``.

    A line that is not exactly one JSON object fails the job; so does a blank line under
    ``blank_lines="error"``. With ``printed`` the column of that name maps those keys whose values are lists or objects
    to what Python prints, for ``records.spelled``.
    """
    lines = read_lines(spark, path, pattern=pattern, written=written)
    return parse_records(lines, blank_lines=blank_lines, printed=printed)


def parse_records(lines: DataFrame, *, blank_lines: str = "skip", printed: Sequence[str] = ()) -> DataFrame:
    # Declared non-deterministic, so that filters and later columns never parse the line again.
    parse = record_and_printed(*printed) if printed else record_of
    parsed = lines.withColumn("_record", parse.asNondeterministic()("line"))
    rows = _strict(F.array("_record"), F.col("_record").isNotNull(), F.col("line"), blank_lines)
    if printed:
        return parsed.select(*lines.columns, F.explode(rows).alias("_record")).select(*lines.columns, "_record.*")
    return parsed.select(*lines.columns, F.explode(rows).alias("record"))


def read_rows(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RESULT_SCHEMA,
    *,
    strict: bool = False,
    blank_lines: str = "skip",
    pattern: str | None = JSONL,
    written: bool = False,
) -> DataFrame:
    """Typed scan of ``schema`` as ``(source_file, *schema)``.

    The lenient form drops blank lines and lines that are not one JSON object; the strict form
    fails on them (on blank ones only under ``blank_lines="error"``).
    """
    lines = read_lines(spark, path, pattern=pattern, written=written)
    return parse_rows(lines, schema, strict=strict, blank_lines=blank_lines)


def parse_rows(
    lines: DataFrame,
    schema: T.StructType = RESULT_SCHEMA,
    *,
    strict: bool = False,
    blank_lines: str = "skip",
) -> DataFrame:
    line = F.col("line")
    guarded = T.StructType([*schema.fields, T.StructField(_GUARD, T.StringType())])
    rows = _one_object(line, guarded, lambda guard: guard[_GUARD].isNotNull())
    if strict:
        rows = _strict(rows, rows.isNotNull(), line, blank_lines)
    return lines.select("source_file", F.inline(rows)).drop(_GUARD)


def _one_object(line: Column, row_type: T.DataType, is_guard: Callable[[Column], Column]) -> Column:
    """The object of a line as an array of one, or NULL when the line is anything else.

    A JSON parser handed a bare line stops after its first value. Here the line sits in an array
    before a closing guard object, so anything left over after the first object is noticed.
    """
    text = F.concat(F.lit("["), line, F.lit(f",{_GUARD_JSON}]"))
    return let(
        F.from_json(text, T.ArrayType(row_type), _JSON_RULES),
        lambda rows: F.when(
            (F.size(rows) == 2) & rows[0].isNotNull() & is_guard(rows[1]), F.slice(rows, 1, 1)
        ),
    )


def _strict(rows: Column, known: Column, line: Column, blank_lines: str) -> Column:
    if blank_lines not in ("skip", "error"):
        raise ValueError("blank_lines is 'skip' or 'error'")
    # The error names the row by its digest and beginning: a line may be of any length.
    shown = F.concat_ws(" ", F.lit("not one JSON object:"), F.substring(line, 1, 200), F.lit("md5"), F.md5(line))
    kept = F.when(known, rows).otherwise(F.raise_error(shown))
    if blank_lines == "error":
        return kept
    # The first test answers for nearly every line without decoding it.
    return F.when(line.startswith("{") | is_visible(line), kept)
