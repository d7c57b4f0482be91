import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from markscale.llm.stream_dedup import read_state, run_stream, sha256, stream_dedup


def weak(body):
    """One of four digests: nearly every hit is a clash."""
    return F.unhex(F.lpad(F.hex(F.crc32(body) % 4), 2, "0"))


def check(rows, texts):
    groups = defaultdict(list)
    for key, text in texts:
        groups[text or ""].append(key)
    by_group = defaultdict(list)
    for r in rows:
        by_group[(r.keep_key, r.group_size)].append(r)
    assert len(rows) == len(texts)
    assert sum(r.kept for r in rows) == len(groups)
    want = sorted((repr(max((k for k in g if k is not None), default=None)), len(g)) for g in groups.values() for _ in g)
    assert sorted((repr(r.keep_key), r.group_size) for r in rows) == want
    assert all(r.key == r.keep_key for r in rows if r.kept)


def test_edge_rows_with_strong_and_weak_digests(spark, edge_docs, tmp_path):
    path = str(tmp_path / "docs")
    edge_docs.withColumn("digest", F.lit(1)).write.parquet(path)
    texts = [(r.doc_id, r.text) for r in edge_docs.collect()]
    for digest in (sha256, weak):
        check(stream_dedup(spark, path, digest=digest).collect(), texts)
    rows = stream_dedup(spark, path).collect()
    assert {bytes(r.digest).hex() for r in rows} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts}


def test_files_that_come_later_meet_the_state(spark, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).coalesce(1).write.parquet(path)
    first = stream_dedup(spark, path, state_dir=state).collect()
    assert all(r.kept for r in first)
    spark.createDataFrame([(3, "a"), (4, None)], schema).coalesce(1).write.mode("append").parquet(path)
    parsed = spark.read.parquet(path).schema
    run_stream(spark, path, parsed, state, "doc_id", "text")
    newest = {r.place.key: r.rows for r in read_state(spark, state, parsed, "doc_id").collect()}
    assert newest == {3: 2, 2: 1, 4: 1}
    again = {r.key: (r.keep_key, r.kept) for r in stream_dedup(spark, path, state_dir=state).collect()}
    assert again == {1: (3, False), 2: (2, True), 3: (3, True), 4: (4, True)}


def test_small_batches_and_no_rows(spark, no_docs, tmp_path):
    many, none = str(tmp_path / "many"), str(tmp_path / "none")
    rows = [(i, f"text {i % 7}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(many)
    check(stream_dedup(spark, many, batch_bytes=1).collect(), rows)
    no_docs.write.parquet(none)
    assert stream_dedup(spark, none).count() == 0
