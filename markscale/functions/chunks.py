"""Splitting a text into sentence chunks."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markscale.functions.text import is_visible, let, strip

# The ideographic full stop ends a sentence; a packed chunk holds up to 24 units.
FULL_STOP = "。"
CHUNK_LIMIT = 24


def characters(text: Column) -> Column:
    return F.length(text)


def words(text: Column) -> Column:
    bare = strip(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"(?U)\s+")))


def sentence_chunks(text: Column, delimiter: str = FULL_STOP) -> Column:
    """Every sentence that is not blank, with its delimiter put back."""
    sentences = F.filter(F.split(text, re.escape(delimiter)), is_visible)
    return F.transform(sentences, lambda s: F.concat(s, F.lit(delimiter)))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _starts(limits: pa.Array, sizes: pa.Array) -> pa.Array:
    """Where chunks start (from 1, and one past the end), from the running sums of the sentences' sizes.

    Each start is found by bisection, so the steps grow with the chunks of a text and not with its length squared.
    """
    limit, found = limits[0].as_py() if len(limits) else 0, []
    for row in range(len(sizes)):
        total = np.concatenate(([0], np.cumsum(sizes[row].values.to_numpy(), dtype=np.int64)))
        starts, at = [], 0
        while at < len(total) - 1:
            starts.append(at + 1)
            at = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        found.append([*starts, at + 1])
    return pa.array(found, pa.list_(pa.int32()))


def packed_chunks(
    text: Column,
    delimiter: str = FULL_STOP,
    limit: int = CHUNK_LIMIT,
    length: Callable[[Column], Column] = characters,
) -> Column:
    """Sentences packed in order into chunks of at most ``limit`` units.

    A text within the limit is one chunk as it stands, and a longer sentence is its own chunk. Only the sizes of
    sentences leave the JVM; what comes back are the chunks' starts, by which the sentences are sliced once.
    """
    long = length(text) > limit
    none = F.array().cast("array<int>")
    sizes = F.when(long, F.transform(sentence_chunks(text, delimiter), lambda s: length(s))).otherwise(none)
    starts = _starts(F.lit(limit), F.coalesce(sizes, none))

    spans = F.zip_with(
        F.slice(starts, F.lit(1), F.size(starts) - 1), F.slice(starts, F.lit(2), F.size(starts)), lambda at, end: F.struct(at.alias("at"), (end - at).alias("n"))
    )
    # A Python function may stand beside a lambda, not in it.
    parts = F.struct(sentence_chunks(text, delimiter).alias("sentences"), spans.alias("spans"))
    packed = let(parts, lambda p: F.transform(p["spans"], lambda c: F.array_join(F.slice(p["sentences"], c["at"], c["n"]), "")))
    return F.when(long, packed).when(text.isNotNull(), F.array(text))
