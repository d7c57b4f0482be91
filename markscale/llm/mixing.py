"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. The documents of each source are shuffled by a hash of their id and laid end to end; every
   ``block_tokens`` words make a block.
2. Targets share the total by weight, none above ``most`` times its source (the excess goes to the
   others by weight); a target is a number of blocks, the last one cut to fit.
3. The unit interval has one cell per block wanted, the sources' cells lying side by side (cumulative
   weights). The van der Corput points visit the cells: point ``i`` falls into the cell whose binary
   digits are those of ``i`` reversed. So each source gets exactly its number of slots, spread evenly
   over the whole schedule.
4. A source's slots are ranked; slot ``r`` takes block ``r`` of the source, beginning again after the
   last block.

- A NULL or empty text has no words: it fills no block and is never taken.
- A NULL source is a source of its own, listed last. Rows alike in id and size are interchangeable.
- An empty table gives an empty schedule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markscale.llm.common import chunked_range, hash52, running_start
from markscale.session import materialise

WORDS = r"[^\x20\x09-\x0D]+"
BLOCKS = 1024


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def repeating_weights(rank: Column, weights: tuple[int, ...] = (1, 2, 3)) -> Column:
    return F.get(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights)).cast("int"))


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """Add ``target``: the total shared by ``weight``, with no source above ``most`` times its size.

    ``sizes`` has one row per source: ``sid``, ``source_size``, ``weight``. In order of cap / weight,
    a source is capped as long as its cap lies below its share of what the earlier ones left over.
    """
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("__ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    caps = sizes.withColumn("__cap", F.col("source_size") * most).withColumn("__ratio", F.col("__cap") / F.col("weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(by_ratio), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))
    marked = caps.withColumn("__capped", F.col("__ratio") <= left / weight_left)
    kept = F.sum("source_size").over(everything) - F.sum(F.when(F.col("__capped"), F.col("__cap")).otherwise(0)).over(everything)
    free = F.sum(F.when(~F.col("__capped"), F.col("weight"))).over(everything)
    shared = F.least(F.col("weight") * (kept / free), F.col("__cap").cast("double"))
    target = F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(shared)
    return marked.withColumn("target", target).drop("__cap", "__ratio", "__capped")


@dataclass(frozen=True)
class Mix:
    """``sources``: one row per source. ``placed``: each document's place in its source.

    ``schedule``: one row per slot (``position``, ``sid``, ``epoch``, ``block``, ``words``).
    """

    sources: DataFrame
    placed: DataFrame
    schedule: DataFrame
    block_tokens: int

    def pieces(self) -> DataFrame:
        """Which words of which document stand in which slot: the mixed corpus, in order of ``position``."""
        b = self.block_tokens
        size, start = F.col("size"), F.col("start")
        spans = chunked_range(
            self.placed.where("size > 0"), F.expr(f"start div {b}"),
            F.expr(f"(start + size - 1) div {b} - start div {b} + 1"), "block",
        )
        low = F.greatest(F.col("block") * b, start)
        # Both sides grow with the corpus; written, they look smaller than they are.
        joined = spans.join(self.schedule.hint("merge"), ["sid", "block"])
        high = F.least(F.col("block") * b + F.col("words"), start + size)
        return joined.where(low < high).select(
            "position", "epoch", "sid", "doc_id", "start", (low - start).alias("from_word"), (high - start).alias("to_word")
        )

    def taken(self) -> DataFrame:
        """``placed`` with the words taken of each document, repeats counted."""
        sums = self.pieces().groupBy("sid", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("__taken"))
        counted = F.when(F.col("size") > 0, F.coalesce("__taken", F.lit(0))).otherwise(0).cast("long")
        return self.placed.join(sums.hint("merge"), ["sid", "start"], "left").withColumn("taken", counted).drop("__taken")


def mix_sources(docs: DataFrame, block_tokens: int = 1024, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> Mix:
    """Plan the mix of ``docs`` (``doc_id``, ``source``, ``text``)."""
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_hash(F.col("text")).alias("text_hash"))
    rows = materialise(narrow, "mix-sizes")  # the texts are read once
    ranked = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ranked.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighted = ranked.withColumn("weight", repeating_weights(F.col("sid"), weights))
    b = F.lit(block_tokens)
    sources = source_targets(weighted, most)
    quota = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most).cast("long")
    sources = sources.withColumn("quota", quota).withColumn("blocks", F.expr(f"(source_size + {block_tokens} - 1) div {block_tokens}"))
    whole = F.expr("coalesce(try_divide(quota - quota % nullif(source_size, 0), source_size), 0)").cast("long")
    rest = F.col("quota") - F.col("epochs") * F.col("source_size")
    sources = sources.withColumn("epochs", whole).withColumn("rest", rest)
    sources = sources.withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / b).cast("long"))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("first_cell", F.coalesce(F.sum("slots").over(before), F.lit(0)))
    total = F.sum("slots").over(Window.partitionBy())
    sources = materialise(sources.withColumn("bits", F.greatest(F.length(F.bin(total)), F.lit(11))), "mix-sources")

    keyed = rows.join(sources.select("sid", F.col("source").alias("__source")), F.col("source").eqNullSafe(F.col("__source")))
    keyed = keyed.drop("__source").withColumn("__h", hash52(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = keyed.withColumn("__part", F.col("__h") % BLOCKS)
    placed = running_start(keyed, ["sid"], "__part", ["__h", "doc_id", "size", "text_hash"], "size", "start").drop("__h", "__part")

    cells = chunked_range(sources, F.col("first_cell"), F.col("slots"), "__cell", dealt=["sid"])
    slots = cells.withColumn("position", F.expr("cast(conv(reverse(lpad(bin(__cell), bits, '0')), 2, 10) as bigint)"))
    # Spark takes exploded rows to be as few as their source; written, their true size decides the joins.
    slots = materialise(slots.drop("__cell", "source", "weight", "target"), "mix-slots")
    slots = slots.withColumns({"__one": F.lit(1), "__part": F.expr("shiftright(position, bits - 10)")})
    slots = running_start(slots, ["sid"], "__part", ["position"], "__one", "rank")
    slots = slots.withColumns({"epoch": F.expr("rank div blocks"), "block": F.expr("rank % blocks")})
    in_block = F.least(b, F.col("source_size") - F.col("block") * b)
    words = F.when(F.col("epoch") < F.col("epochs"), in_block).otherwise(F.least(in_block, F.col("rest") - F.col("block") * b))
    schedule = slots.select("position", "sid", "epoch", "block", words.cast("long").alias("words"))
    return Mix(sources, placed, schedule, block_tokens)


def repeat_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` as whole documents: each as many times as the mix takes it, halves rounded up.

    A document is known by source, id and text, so ids that sources share, or that are NULL, keep to their own
    counts. Rows alike in all three share what the mix takes of them.
    """
    counts = mix.taken().where("size > 0").groupBy(
        F.col("source").alias("__source"), F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")
    ).agg(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).alias("__times"), F.count(F.lit(1)).alias("__rows"))
    same = (
        docs["source"].eqNullSafe(F.col("__source")) & docs["doc_id"].eqNullSafe(F.col("__id"))
        & (text_hash(docs["text"]) == F.col("__text"))
    )
    joined = docs.join(counts.hint("merge"), same)
    alike = Window.partitionBy("__source", "__id", "__text").orderBy("__text")
    times = F.expr("__times div __rows") + (F.row_number().over(alike) <= F.expr("__times % __rows")).cast("long")
    repeated = joined.withColumn("__copies", times).where("__copies > 0")
    return repeated.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)
