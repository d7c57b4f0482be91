"""JSON-lines and CSV sinks. Every sink replaces what its folder held before.

An output that belongs to one input file is a ``source_file=<name>`` folder, so that files of any
size are written by as many tasks as read them. The names carry the stage prefixes below.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markscale.functions.records import object_text
from markscale.functions.text import python_float_text
from markscale.session import scratch_path
from markscale.sources.jsonl import MANIFEST, MANIFEST_TYPE

# Name prefixes of the per-file outputs.
SCORED_PREFIX = "processed_"
JUDGED_PREFIX = "llmjudge_"
FAILED_PREFIX = "failed_"


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Rename ``source_file`` for the output of a stage."""
    return df.withColumn("source_file", F.concat(F.lit(prefix), F.col("source_file")))


def write_records(df: DataFrame, path: str, *, record: str = "record", per_file: bool = True) -> None:
    """Write open-schema rows, one JSON object per line."""
    line = object_text(F.col(record)).alias("line")
    if per_file:
        df.select(line, "source_file").write.mode("overwrite").partitionBy("source_file").text(path)
    else:
        df.select(line).write.mode("overwrite").text(path)


def write_plain(lines: DataFrame, path: str, *, files: DataFrame | None = None) -> None:
    """Write ``(source_file, line)`` rows as a folder of plain files, one ``<source_file>.jsonl`` for each name.

    ``files`` (``source_file``) names files that must be there even without a row: those are empty. A manifest beside the
    data tells the rows and bytes of every file. A file is written by one task, files by many; the driver only
    moves finished files to their names. For outputs of any size per file use :func:`write_records`.
    """
    spark = lines.sparkSession
    staged = scratch_path(spark, "plain")
    lines.select("line", "source_file").repartition("source_file").write.partitionBy("source_file").text(staged)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    target = Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target):
        system.delete(target, True)
    system.mkdirs(target)
    names = set()
    for status in system.globStatus(Path(f"{staged}/source_file=*/part-*")) or []:
        name = unquote(status.getPath().getParent().getName().removeprefix("source_file="))
        names.add(name)
        system.rename(status.getPath(), Path(target, f"{name}.jsonl"))
    counts = lines.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("line") + 1).cast("long").alias("bytes")
    )
    if files is not None:
        known = files.select("source_file").distinct()
        for row in known.toLocalIterator():
            if row.source_file not in names:
                system.create(Path(target, f"{row.source_file}.jsonl")).close()
        counts = known.join(counts, "source_file", "full").fillna(0, ["rows", "bytes"])
    counts.select(*T.StructType.fromDDL(MANIFEST_TYPE).names).write.parquet(f"{path.rstrip('/')}/{MANIFEST}")


def write_rows(df: DataFrame, path: str, *, per_file: bool = True) -> None:
    """Write typed columns as JSON objects; NULL columns are written as JSON nulls."""
    names = [name for name in df.columns if not (per_file and name == "source_file")]
    line = F.to_json(F.struct(*(F.col(f"`{name}`") for name in names)), {"ignoreNullFields": "false"})
    selected = df.select(line.alias("line"), *(["source_file"] if per_file else []))
    writer = selected.write.mode("overwrite")
    (writer.partitionBy("source_file") if per_file else writer).text(path)


def write_csv(df: DataFrame, path: str, keys: list[str], *, per_file: bool = True) -> None:
    """Write a result table sorted by its keys, with a header and empty fields for missing values.

    Numbers are spelled as floats (``2.0``, ``1e-05``), the group size included.
    """
    floats, columns = [], []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.IntegralType):
            column = F.concat(column.cast("string"), F.lit(".0"))
        elif isinstance(field.dataType, T.NumericType):
            floats.append(F.nanvl(column.cast("double"), F.lit(None).cast("double")))
            column = F.col("_floats")[len(floats) - 1]
        columns.append(column.alias(field.name))
    if floats:
        # One spelling expression for all columns keeps the plan small.
        df = df.withColumn("_floats", F.transform(F.array(*floats), python_float_text))
    order = (["source_file"] if per_file else []) + keys
    # A range shuffle spreads a large table of one file over tasks and keeps the rows in order.
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)
    writer = (
        ordered.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    (writer.partitionBy("source_file") if per_file else writer).csv(path)
