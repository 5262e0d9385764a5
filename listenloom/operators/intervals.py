"""Merging intervals of one owner that lie within a gap of each other.

A play is an interval of length zero, a session one of some length, so splitting
plays into sessions and joining sessions bridged by late plays are one operation.

Rows are first merged inside slices of the calendar, ``(owner, floor(start /
slice_seconds))``. What is left lies more than the gap apart in its slice, so an owner
has at most one interval for every ``gap`` seconds of the calendar, however many rows
there were, and those are merged owner by owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def heads(df: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    """``keys, start, stop, n``: intervals of ``keys, start, stop, n`` merged inside each group of ``keys``."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") - before > gap), F.col("start"))
    marked = df.withColumn("head", opens)
    island = F.last("head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("head", island).groupBy(*keys, "head").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n")).drop("head")


def merge_intervals(df: DataFrame, owner: str, start: str, stop: str, n: str | None, gap: int, slice_seconds: int = DAY) -> DataFrame:
    """``owner, start, stop, n``: unions of intervals no more than ``gap`` apart.

    ``n`` is the sum of the column named (or the number of rows). Rows with a null
    owner, start or stop are left out; intervals of equal start are merged, so ties
    don't matter. Empty input gives no rows. Other columns are ignored.
    """
    rows = df.select(
        F.col(f"`{owner}`").alias("owner"),
        F.col(f"`{start}`").cast("bigint").alias("start"),
        F.col(f"`{stop}`").cast("bigint").alias("stop"),
        (F.col(f"`{n}`").cast("bigint") if n else F.lit(1).cast("bigint")).alias("n"),
    ).where("owner is not null and start is not null and stop is not null")
    return merge_sliced(rows.withColumn("slice", slice_of(F.col("start"), slice_seconds)), gap)


def slice_of(c: Column, slice_seconds: int) -> Column:
    return F.floor(c / F.lit(slice_seconds)).cast("int")


def merge_sliced(rows: DataFrame, gap: int) -> DataFrame:
    """:func:`merge_intervals` of rows ``owner, slice, start, stop, n``."""
    return heads(heads(rows, gap, ["owner", "slice"]), gap, ["owner"])
