"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markscale.session import deal

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word after ``lower_ascii``: ASCII letters and digits, and every character beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return deal(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only. Pure ASCII text takes the faster built-in."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; a NULL text has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def hash52(text: Column) -> Column:
    """A whole number below 2**52 from the MD5 of a string: the same in every engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def running_start(
    rows: DataFrame, keys: list[str], block: str, order: list[str], value: str, out: str, small: bool = False
) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the same keys, by ``block`` and then ``order``.

    A hot key does not meet in one task: the sums of its blocks are totalled first (one row per key
    and block), and rows are ordered within their block only. ``keys`` and ``block`` are not NULL.
    ``small`` says that keys x blocks has a fixed bound, so that the block sums may be broadcast.
    """
    on = [*keys, block]
    sums = rows.groupBy(*on).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*on, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(F.broadcast(starts) if small else starts, on)
    total = F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn(out, total.cast("long")).drop("__start")


def chunked_range(
    df: DataFrame, first: Column, count: Column, out: str, chunk: int = 1 << 16, dealt: list[str] | None = None
) -> DataFrame:
    """One row for each of ``count`` whole numbers from ``first``; no array is longer than ``chunk``.

    With ``dealt``, columns that tell the rows of ``df`` apart, chunks go to different tasks before they are written out.
    """
    rows = df.withColumns({"__first": first, "__count": count}).where("__count > 0")
    rows = rows.withColumn("__chunk", F.explode(F.expr(f"sequence(0L, cast((__count - 1) div {chunk} as bigint))")))
    if dealt:
        rows = rows.repartition(*dealt, "__chunk")
    low = F.col("__first") + F.col("__chunk") * chunk
    high = F.least(low + chunk, F.col("__first") + F.col("__count")) - 1
    return rows.withColumn(out, F.explode(F.sequence(low, high))).drop("__first", "__count", "__chunk")
