"""From raw documents to sharded training data: five stages, each one of the operators.

Every stage reads all that its predecessor kept, written as Parquet; all but the last return the
columns of ``documents`` (further columns pass through).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markscale.llm import decontaminate, mixing, ngram_join, quality_mil, sharding
from markscale.llm.common import table
from markscale.llm.queries import QUALITY_THRESHOLD, SHARDS
from markscale.session import configure, materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, fitted on the labelled ones among them, rejects."""
    configure(spark)
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_mil.add_score(docs, model, out="__quality")
    return scored.where(F.col("__quality") >= QUALITY_THRESHOLD).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of every class of documents linked by similarity."""
    configure(spark)
    return ngram_join.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which benchmark passages cover a twentieth or more."""
    judged = decontaminate.judge_documents(docs, table(spark, sf_dir, "benchmark"))
    bad = judged.where(decontaminate.contaminated(decontaminate.hit_words(F.col("hits")), F.col("n_words")))
    return decontaminate.drop_documents(docs, bad)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents so that every source comes to its target."""
    return mixing.repeat_documents(docs, mixing.mix_sources(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add each document's ``shard``."""
    return sharding.assign_shards(docs, "doc_id", [1.0] * SHARDS)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("mix", mix),
    ("shards", shard),
]

#: A fitted classifier has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
