"""Exact deduplication as a stream with disk-backed keyed state.

Files of documents arrive as a stream. The state keeps, per content digest and without expiry, how
many rows have had it, the row that stays (largest stable identifier) and where its content lies
(file and row number). It is a streaming aggregation over the RocksDB state store: state lives on
disk and in the checkpoint, and the rows of a hot group are summed up per task before they meet.
A stopped stream goes on where it ended; files that come later meet the state of all earlier ones.

Each micro-batch appends the digests that it changed; the newest entry of a digest holds.

A digest that is hit twice only proposes equality: the full bytes of all rows of a digest are
compared, and a digest with differing texts is resolved by the texts themselves.

- A NULL text counts as empty. Rows that repeat an identifier and text are told apart by their place;
  one of them stays. A NULL identifier ranks below all others.
- Columns beyond identifier and text are not read. A folder without rows gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from markscale.session import materialise, scratch_path

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: no log space is set aside for each.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # All state stores of one executor share this much memory.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Input bytes of one micro-batch.
BATCH_BYTES = 64 << 30

Digest = Callable[[Column], Column]


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def with_content(df: DataFrame, key: str, text: str, digest: Digest) -> DataFrame:
    """``key``, ``body``, ``digest``, and ``place`` = (identifier, file, row): a total order of the rows."""
    # Decoded first: a file's path reads alike as a stream and as a table.
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    place = F.struct(F.col(key).alias("key"), file.alias("file"), row.alias("row"))
    return df.select(F.col(key).alias("key"), body.alias("body"), digest(body).alias("digest"), place.alias("place"))


def run_stream(
    spark: SparkSession, path: str, schema: StructType, state_dir: str, key: str, text: str,
    digest: Digest = sha256, batch_bytes: int = BATCH_BYTES,
) -> None:
    """Take in every file of ``path`` that ``state_dir`` has not seen; return when all are in."""
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        # As a pattern that matches just ``path``, which may then be a folder or one file.
        exactly = f"{path[:-1]}[{path[-1]}]"
        source = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(exactly)
        state = (
            with_content(source, key, text, digest)
            .groupBy("digest")
            .agg(F.max("place").alias("place"), F.count(F.lit(1)).alias("rows"))
        )

        def keep(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{state_dir}/changes/batch={batch}")

        query = (
            state.writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", f"{state_dir}/checkpoint").foreachBatch(keep).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, state_dir: str, schema: StructType, key: str) -> DataFrame:
    """The newest entry of every digest: ``digest``, ``place`` of the row that stays, ``rows``."""
    kind = schema[key].dataType.simpleString()
    entry = f"digest binary, place struct<key:{kind},file:string,row:bigint>, rows bigint, batch int"
    changes = spark.read.schema(entry).parquet(f"{state_dir}/changes")
    newest = changes.groupBy("digest").agg(F.max(F.struct("batch", "place", "rows")).alias("__n"))
    return newest.select("digest", "__n.place", "__n.rows")


def stream_dedup(
    spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", state_dir: str | None = None,
    digest: Digest = sha256, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row per input row: ``key``, ``digest``, ``keep_key``, ``group_size``, ``kept``."""
    path = path.rstrip("/")
    given = spark.read.parquet(path).schema
    schema = StructType([given[key], given[text]])
    state_dir = state_dir or scratch_path(spark, "dedup-state")
    run_stream(spark, path, schema, state_dir, key, text, digest, batch_bytes)
    # Written: the join below is then one of plain exchanges, in which Spark can split a hot digest.
    groups = materialise(read_state(spark, state_dir, schema, key), "dedup-groups")

    rows = with_content(spark.read.schema(schema).parquet(path), key, text, digest)
    # Every byte is compared: rows of one digest that differ anywhere stay apart here.
    texts_seen = rows.select("digest", "body").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    # As a rule empty. Written, so that its true size decides how it is joined.
    mixed = materialise(texts_seen.where("n > 1").select("digest", F.lit(True).alias("mixed")), "dedup-clashes")
    marked = groups.join(mixed, "digest", "left")
    alike = (
        rows.select("key", "digest", "place")
        .join(marked.where("mixed is null").select("digest", F.col("place").alias("__stays"), "rows"), "digest")
        .select("key", "digest", F.col("__stays.key").alias("keep_key"), F.col("rows").alias("group_size"),
                F.col("place").eqNullSafe(F.col("__stays")).alias("kept"))
    )
    # Digests that differing texts share: their groups are the texts.
    clashing = rows.join(mixed.select("digest"), "digest")
    texts = clashing.groupBy("digest", "body").agg(F.max("place").alias("__stays"), F.count(F.lit(1)).alias("group_size"))
    told_apart = clashing.join(texts, ["digest", "body"]).select(
        "key", "digest", F.col("__stays.key").alias("keep_key"), "group_size",
        F.col("place").eqNullSafe(F.col("__stays")).alias("kept"),
    )
    return alike.unionByName(told_apart)
