"""Lookup join that splits hot keys over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE
# hot keys whatever the size of the data. That bounds the one table that is broadcast.
HOT_SHARE = 1_000


def lookup_join(rows: DataFrame, table: DataFrame, key: str, count_col: str) -> DataFrame:
    """Left join of ``rows`` to ``table`` on ``key``.

    ``table`` is a written table with one row per key, where ``count_col`` tells how many of
    ``rows`` have that key, or bounds it. Rows of hot keys are dealt over several shuffle keys and
    their one table row is repeated for each; all other keys join as they are.
    """
    total = table.agg(F.sum(count_col)).first()[0] or 0
    threshold = max(1, total // HOT_SHARE)
    splits = F.ceil(F.col(count_col) / threshold).cast("int")
    hot = table.filter(F.col(count_col) > threshold).select(key, splits.alias("_splits"))
    dealt = (
        rows.withColumn("_row", F.monotonically_increasing_id())
        .join(F.broadcast(hot), key, "left")
        # Hashed, so that no regular order of the rows can favour some of the splits.
        .withColumn("_split", F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_splits")), F.lit(0)).cast("int"))
        .drop("_row", "_splits")
    )
    last = F.when(F.col(count_col) > threshold, splits - 1).otherwise(F.lit(0))
    repeated = table.withColumn("_split", F.explode(F.sequence(F.lit(0), last))).drop(count_col)
    return dealt.join(repeated, [key, "_split"], "left").drop("_split")
