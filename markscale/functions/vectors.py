"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markscale.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def unit(vector: Column) -> Column:
    """``vector`` scaled to length one; a zero vector stays zero."""

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x))
        return let(norm, lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)))

    return let(vector.cast("array<double>"), scaled)


def mean_unit(vectors: Column) -> Column:
    """Mean of the unit vectors of ``array<array<double>>``; NULL when there are none.

    The mean cosine over all pairs of two sets is the dot product of their mean unit vectors,
    which takes m + n steps instead of m * n.
    """

    def averaged(rows: Column) -> Column:
        total = F.aggregate(
            rows,
            F.transform(rows[0], lambda _: F.lit(0.0)),
            lambda acc, row: F.zip_with(acc, unit(row), lambda x, y: x + y),
        )
        return F.when(F.size(rows) > 0, F.transform(total, lambda x: x / F.size(rows)))

    return let(vectors.cast("array<array<double>>"), averaged)
