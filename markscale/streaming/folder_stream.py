"""New JSON-lines files of a folder as a stream.

The lines have the columns of ``sources.jsonl.read_lines``, so ``parse_records`` and ``parse_rows``,
the row-wise operators and ``report`` with a named ``score_source`` apply to them unchanged. A
report over a stream is written in complete mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from markscale.sources.jsonl import JSONL, named_lines


def stream_lines(spark: SparkSession, folder: str, *, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return named_lines(reader, folder, JSONL)
