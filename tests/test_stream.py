from pyspark.sql import functions as F

from markscale.functions.records import object_text
from markscale.operators import prep
from markscale.operators.report import report
from markscale.sources.jsonl import parse_records, parse_rows
from markscale.streaming.folder_stream import stream_lines


def drain(stream, mode, name):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_report_over_arriving_files(spark, write_lines):
    folder = write_lines(
        a=['{"id":"en_01","model":"m","similarity":1,"LLMJudge result":"[Correct]"}', "{bad", ""],
        b=['{"id":"en_01","model":"m","similarity":2}'],
    )
    rows = parse_rows(stream_lines(spark, folder, max_files_per_trigger=1)).withColumn("source_file", F.lit("all"))
    results = drain(report(rows, score_source="similarity"), "complete", "running_report")
    row = results.filter("table = 'by_model'").first()
    assert (row.n_total, row.similarity_mean, row.similarity_se, row.accuracy) == (2, 1.5, 0.5, 0.5)


def test_rows_are_cleaned_as_they_arrive(spark, write_lines):
    folder = write_lines(a=['{",language":"ZH","id":1}', ""])
    rows = prep.normalize(parse_records(stream_lines(spark, folder)))
    out = drain(rows.select(object_text(F.col("record")).alias("line")), "append", "clean_rows")
    assert [r.line for r in out.collect()] == ['{"id":"1","language":"cn"}']
