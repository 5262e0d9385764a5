"""Dense vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """``a`` at length one; a zero vector stays as it is."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(TINY)))


def cosine_distance(a: Column, b: Column) -> Column:
    """One less the product of two unit vectors, within [0, 2]."""
    return F.least(F.greatest(1 - dot(a, b), F.lit(0.0)), F.lit(2.0))
