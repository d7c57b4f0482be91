"""Merkle manifest of a dataset: a tree of hashes per group of rows, a tree over the groups, and a proof per row.

Leaves stand in order within their group; while a group has several nodes, each ``FAN`` neighbours (at the end of
the group fewer, even one) become one. A level is kept as one string: an aligned block of ``FAN ** HEIGHT``
nodes holds the 64 hex digits of all of them in a row, and fixed-width substrings of it are hashed to the
next level's string. What flanks a node within its run is its sibling segment. The roots of the blocks are the
nodes of the next round, until every group has one; the groups' roots then go the same way. Each round is a
table, so proofs join a round's few blocks to the paths of the round above, and rows meet no other row's text.

Places in a group come from a range shuffle of the short rows (digests, not texts) and counts per range, so that
a group of any size is ordered by many tasks; a block is bounded, whatever the size of its group.

``H`` is SHA-256 as lower-case hex digits; inputs are joined as they are, digests as their hex text.

- A field counts as ``-`` if NULL, else as its UTF-8 bytes, ``:`` and its value, so no two rows read alike.
- Order: NULL first, then the order column, ties by leaf. Rows alike in all fields are leaves of their own.
- A group of one row is its leaf. NULL is a group of its own, before all others; groups are ordered by their bytes.
- Empty and long texts are fields like any other, hashed whole. An empty table has no root and gives no rows.
- Other columns are no part of a leaf unless they are named; names that begin with two underscores are reserved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markscale.session import materialise

FAN, HEIGHT, DIGEST = 3, 6, 64


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field_text(column: Column) -> Column:
    """``-``, or the length in bytes and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return digest(F.concat(*map(field_text, columns)))


def group_key(column: Column) -> Column:
    """A string that is never NULL and in whose bytes NULL comes first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` (written) with ``__place`` in their group, from 0, and ``__size``, the group's number of rows.

    ``group`` is never NULL. Rows are numbered along the ranges; what is subtracted is the number of
    the group's first row. Only counts per range and group are gathered, one row each.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    # The upper bits are the range, the lower 33 the row's number in it.
    ranged = ranged.withColumn("__row", F.monotonically_increasing_id())
    ranged = ranged.withColumn("__range", F.shiftright("__row", 33).cast("int"))
    written = materialise(ranged, "manifest-order")
    runs = written.groupBy(group, "__range").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # A group's run ends its range unless it is the last one there, so runs of one group are neighbours.
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns(
        {
            "__before": F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first"),
            "__size": F.sum("__n").over(Window.partitionBy(group)),
        }
    ).drop("__first", "__n")
    found = written.join(runs, [group, "__range"])
    return found.withColumn("__place", F.col("__row") + F.col("__before")).drop("__row", "__range", "__before")


def parent_level(level: Column, fan: int) -> Column:
    """The string of the next level: the hash of every ``fan`` digests in a row."""
    width = fan * DIGEST
    starts = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / width).cast("int"))
    hashes = F.transform(starts, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256))
    return F.array_join(hashes, "").cast("binary")


def levels_of(nodes: Column, size: Column, fan: int, height: int) -> Column:
    """All levels of a block. A group of one block is raised to its root, else every block by ``height``."""
    steps = sum((size > fan**k).cast("int") for k in range(height))
    bottom = F.array(F.array_join(nodes, "").cast("binary"))
    raised = F.aggregate(
        F.sequence(F.lit(1), steps), bottom, lambda all_, _: F.concat(all_, F.array(parent_level(F.element_at(all_, -1), fan)))
    )
    return F.when(steps > 0, raised).otherwise(bottom)


def siblings(levels: Column, place: Column, fan: int) -> Column:
    """Per level below the top, the digests on the left and on the right of a node's run."""

    def flanks(level: Column, depth: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(fan)), depth.cast("double"))).cast("int")
        start = at - at % fan
        left = F.substring(level, start * DIGEST + 1, (at - start) * DIGEST)
        right = F.substring(level, (at + 1) * DIGEST + 1, (start + fan - 1 - at) * DIGEST)
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), flanks)


@dataclass
class Rounds:
    """Written tables of blocks, from the leaves up, and every group's root with its number of leaves."""

    blocks: list[DataFrame]
    roots: DataFrame
    group: str
    fan: int

    def paths(self, ends: DataFrame | None = None) -> DataFrame:
        """The rows of the first round: their columns, ``__place`` and ``path``, the flanks from leaf to root.

        ``ends`` has a row per group: what its paths go on with, ``__above``, and columns that its rows get.
        """
        if ends is None:
            ends = self.roots.select(self.group, F.array().cast("array<struct<left:binary,right:binary>>").alias("__above"))
        added = [c for c in ends.columns if c not in (self.group, "__above")]
        above, on = ends, [self.group]
        for blocks in reversed(self.blocks):
            members = blocks.join(above, on).select(
                self.group, "__levels", "__above", *added, F.posexplode("__members").alias("__at", "__m")
            )
            path = F.concat(siblings(F.col("__levels"), F.col("__at"), self.fan), F.col("__above"))
            out = members.select(self.group, "__m.*", *added, path.alias("path"))
            above, on = out.select(self.group, F.col("__place").alias("__block"), *added, F.col("path").alias("__above")), [self.group, "__block"]
        return out


def raise_groups(nodes: DataFrame, group: str, fan: int = FAN, height: int = HEIGHT) -> Rounds:
    """Trees over ``nodes``: ``group`` (never NULL), ``__place``, ``__size``, ``node`` and any other columns, kept with the leaves."""
    width, blocks = fan**height, []
    while True:
        members = F.struct("__place", *(c for c in nodes.columns if c not in (group, "__place", "__size")))
        grouped = nodes.groupBy(group, F.expr(f"__place div {width}").alias("__block")).agg(
            F.max("__size").alias("__size"), F.array_sort(F.collect_list(members)).alias("__members")
        )
        levels = levels_of(F.col("__members.node"), F.col("__size"), fan, height)
        written = materialise(grouped.withColumn("__levels", levels), "manifest-blocks")
        blocks.append(written)
        tops = written.select(
            group, F.col("__block").alias("__place"), F.ceil(F.col("__size") / width).alias("__size"),
            F.element_at("__levels", -1).cast("string").alias("node"),
        )
        if not (written.agg(F.max("__size")).first()[0] or 0) > width:
            return Rounds(blocks, tops.select(group, F.col("node").alias("root")), group, fan)
        # Groups that have their root stay one node; the further levels of others do not touch it.
        nodes = tops


def fold(node: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    text = node.cast("binary")
    return F.aggregate(
        path, text, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]), 256).cast("binary"), lambda acc: acc.cast("string")
    )


def proof_digest(path: Column) -> Column:
    """``H`` of the siblings, level by level, from left to right."""
    return F.sha2(F.concat(F.lit("").cast("binary"), F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"]).cast("string")), "").cast("binary")), 256)


def manifest(rows: DataFrame, group: str, order: str, node: str, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """``rows`` (short ones: all of their columns are carried along) with ``subroot``, ``root`` and ``path``.

    ``node`` names the column of leaves, ``group`` and ``order`` those that place them. Builds and writes
    the trees when it is called.
    """
    keyed = rows.withColumnRenamed(node, "node").withColumn("__group", group_key(F.col(group)))
    trees = raise_groups(placed(keyed, "__group", [order, "node"]), "__group", fan, height)
    # The groups' roots are the leaves of one more tree.
    roots = trees.roots.select(F.lit("").alias("__all"), F.col("__group").alias("__name"), F.col("root").alias("node"))
    top = raise_groups(placed(roots, "__all", ["__name"]), "__all", fan, height)
    ends = top.paths().join(top.roots, "__all").select(
        F.col("__name").alias("__group"), F.col("node").alias("__subroot"), F.col("root").alias("__root"), F.col("path").alias("__above")
    )
    found = trees.paths(materialise(ends, "manifest-groups"))
    return found.withColumnRenamed("node", node).select(
        *rows.columns, F.col("__subroot").alias("subroot"), F.col("__root").alias("root"), "path"
    )


def verified(node: Column, path: Column, root: Column) -> Column:
    return fold(node, path) == root
