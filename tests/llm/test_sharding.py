import math
import zlib
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from markscale.llm.sharding import assign_grown, assign_shards, number_slots


def expected_shard(key, weights):
    scores = []
    for i, w in enumerate(weights):
        h = int(md5(f"{'' if key is None else key}:{i}".encode()).hexdigest()[:13], 16)
        scores.append((-math.log((h + 0.5) / 2**52) / w, i))
    return min(scores)[1]


def test_shards_follow_the_hash_and_the_weights(spark):
    keys = spark.range(4000).withColumnRenamed("id", "k")
    weights = [1.0, 2.0, 1.0]
    rows = assign_shards(keys, "k", weights).collect()
    assert all(r.shard == expected_shard(r.k, weights) for r in rows)
    counts = Counter(r.shard for r in rows)
    assert abs(counts[1] / 4000 - 0.5) < 0.05


def test_one_more_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(3000).withColumnRenamed("id", "k")
    rows = assign_grown(keys, "k", [1.0] * 7).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert all(r.grown_shard == 7 for r in moved)
    assert 0.08 < len(moved) / 3000 < 0.18


def test_slots_are_gapless_with_nulls_and_repeated_rows(spark, edge_docs):
    narrow = edge_docs.select("doc_id", F.octet_length("text").alias("size"))
    hot = spark.range(500).select(F.lit(42).cast("long").alias("doc_id"), F.lit(3).alias("size"))
    rows = number_slots(assign_shards(narrow.unionByName(hot), "doc_id", [1.0] * 4), ["doc_id", "size"]).collect()
    assert len(rows) == 513
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_clashing_columns_and_empty_tables(edge_docs, no_docs):
    clashing = edge_docs.withColumn("shard", F.lit("mine")).withColumn("slot", F.lit(9))
    assert dict(assign_shards(clashing, "doc_id", [1.0, 1.0]).dtypes)["shard"] == "int"
    assert assign_shards(no_docs, "doc_id", [1.0]).count() == 0
    assert number_slots(assign_shards(no_docs, "doc_id", [1.0]).select("doc_id", "shard"), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        assign_shards(edge_docs, "doc_id", [1.0, 0.0])


def test_checksum_matches_zlib(spark, sf_dir):
    from markscale.llm.queries import sharding_query

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in sharding_query(spark, sf_dir).collect():
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
