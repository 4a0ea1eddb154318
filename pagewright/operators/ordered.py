"""Ordered work per group that survives a group holding a large part of all rows.

A plain window over a hot key sorts that key in one task. Here every group is cut into slices by a
number that never decreases along the order (``range_slices``, or a coarse place where that is bounded). Windows run inside
slices; what one slice owes the next is a single row per slice, and only those rows meet in a
second, far smaller window. Results are exactly those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SLICE = "_slice"


def range_slices(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Adds a slice number by a range sort over the keys and the whole order, written once.

    Slices hold about as many rows each wherever the rows lie: a hot group, a burst in one hour and a tied value (told apart by what follows it in the
    order, then by row) are cut like anything else. Spark takes the bounds from a sample it draws below the shuffle.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    return cut(tied.repartitionByRange(*keys, *order, "_tie").drop("_tie").withColumn(SLICE, F.spark_partition_id()))


def _with_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with the ``_carry`` of its group and slice; a null key or slice meets its like."""
    names = [*keys, SLICE]
    held = carry.select(*[F.col(c).alias(f"_at{i}") for i, c in enumerate(names)], "_carry")
    same = [df[c].eqNullSafe(held[f"_at{i}"]) for i, c in enumerate(names)]
    return df.join(held, same).drop(*[f"_at{i}" for i in range(len(names))])


def _before(per_slice: DataFrame, keys: list[str], value: Column) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(*keys, SLICE, value.over(by).alias("_carry"))


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` along the order, per group. ``df`` carries ``_slice``."""
    work = df.withColumn("_v", value)
    totals = work.groupBy(*keys, SLICE).agg(F.sum("_v").alias("_t"))
    carry = _before(totals, keys, F.sum("_t"))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _with_carry(work.withColumn("_in", F.sum("_v").over(inside)), carry, keys)
        .withColumn(name, F.col("_in") + F.coalesce("_carry", F.lit(0)))
        .drop("_v", "_in", "_carry")
    )


def running_max(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Inclusive running maximum of ``value`` along the order, per group."""
    work = df.withColumn("_v", value)
    tops = work.groupBy(*keys, SLICE).agg(F.max("_v").alias("_t"))
    carry = _before(tops, keys, F.max("_t"))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _with_carry(work.withColumn("_in", F.max("_v").over(inside)), carry, keys)
        .withColumn(name, F.greatest("_in", "_carry"))
        .drop("_v", "_in", "_carry")
    )


def number_rows(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Dense row number from 1 along the order, per group (no keys: over everything)."""
    counts = df.groupBy(*keys, SLICE).agg(F.count("*").alias("_t"))
    carry = _before(counts, keys, F.sum("_t"))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    return (
        _with_carry(df.withColumn("_in", F.row_number().over(inside)), carry, keys)
        .withColumn(name, F.col("_in") + F.coalesce("_carry", F.lit(0)))
        .drop("_in", "_carry")
    )


def previous(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``value`` of the row before along the order, per group; null for the first."""
    work = df.withColumn("_v", F.struct(value.alias("v")))
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    lasts = work.groupBy(*keys, SLICE).agg(F.max_by("_v", rank).alias("_t"))
    by = Window.partitionBy(*keys).orderBy(SLICE)
    carry = lasts.select(*keys, SLICE, F.lag("_t").over(by).alias("_carry"))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    return (
        _with_carry(work.withColumn("_in", F.lag("_v").over(inside)), carry, keys)
        .withColumn(name, F.coalesce("_in", "_carry")["v"])
        .drop("_v", "_in", "_carry")
    )


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row ``median``: the mean of the two middle values, found by numbering slices instead of one big sort."""
    some = df.filter(F.col(value).isNotNull()).select(value)
    numbered = number_rows(range_slices(some, [], [value]), [], [F.col(value)], "_n")
    n = some.agg(F.count("*").alias("n"))
    return numbered.withColumn("_c", n.scalar()).filter("_n = (_c + 1) div 2 OR _n = _c div 2 + 1").agg(F.avg(value).alias("median"))
