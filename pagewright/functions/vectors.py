"""Vector expressions over array columns, evaluated inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def unit(a: Column) -> Column:
    """Length one in double precision; a zero vector stays zero."""
    wide = a.cast("array<double>")
    length = norm(wide)
    return F.when(length > 0, F.transform(wide, lambda v: v / length)).otherwise(wide)


def cosine_unit(a: Column, b: Column) -> Column:
    """Cosine of two vectors already of unit length."""
    return dot(a, b)


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def centred_unit(a: Column) -> Column:
    """Mean removed, then unit length: the dot of two of these is their correlation."""
    m = mean(a)
    return unit(F.transform(a, lambda v: v - m))
