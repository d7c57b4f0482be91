"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions only.

Every (key, shard) pair draws a number u in (0, 1) from a hash; the shard with the smallest
``-ln(u) / weight`` takes the record. A shard's share of the keys follows its weight, and the draw of
a pair knows nothing of the other shards: one shard more takes rows only into itself.

- A NULL key hashes like the empty string. Rows with the same key share a shard.
- ``out`` columns replace columns of the same name; other columns pass through.
- An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscale.llm.common import chunked_range, hash52, key_text, running_start

#: Sub-ranges of a shard that are numbered apart: 1024 x shards counts in all, whatever the input.
BLOCKS = 1024


def shard_scores(key: Column, weights: Sequence[float]) -> list[Column]:
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a weight above 0")
    text = key_text(key)
    draws = [hash52(F.concat_ws(":", text, F.lit(str(i)))) for i in range(len(weights))]
    return [
        F.struct((-F.ln((h + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard"))
        for i, (h, w) in enumerate(zip(draws, weights))
    ]


def best(scores: list[Column]) -> Column:
    """The shard of the smallest score; of equal scores the lower shard."""
    return F.array_min(F.array(*scores))["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """Add each row's shard, 0 to ``len(weights) - 1``. No shuffle."""
    return df.withColumn(out, best(shard_scores(F.col(key), weights)).cast("int"))


def assign_grown(
    df: DataFrame, key: str, weights: Sequence[float], added: float = 1.0, out: str = "shard", grown: str = "grown_shard"
) -> DataFrame:
    """``assign_shards`` plus the shard after one more shard of weight ``added`` has come."""
    scores = F.array(*shard_scores(F.col(key), [*weights, added]))
    row = df.withColumn("__scores", scores)
    now = F.array_min(F.slice("__scores", 1, len(weights)))["shard"]
    later = F.array_min("__scores")["shard"]
    return row.withColumn(out, now.cast("int")).withColumn(grown, later.cast("int")).drop("__scores")


def number_slots(rows: DataFrame, order: Sequence[str], shard: str = "shard", blocks: int = BLOCKS) -> DataFrame:
    """Add ``slot``, gapless from 0 within each shard, by block of the row's hash and then ``order``.

    ``rows`` holds narrow columns only (no texts); rows alike in all of them are counted first and
    dealt their slots afterwards, so that a third of all rows being one row is one small group. Each
    shard is cut into ``blocks`` hash ranges which are numbered in parallel.
    """
    block = (hash52(F.concat_ws(":", *[key_text(F.col(c)) for c in order])) % blocks).cast("int")
    groups = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__block", block)
    placed = running_start(groups, [shard], "__block", list(order), "__n", "__at", small=True)
    return chunked_range(placed, F.col("__at"), F.col("__n"), "slot").select(*rows.columns, "slot")
