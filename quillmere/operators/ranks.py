"""Ranks over a whole table without one task that sees it all.

The rows are dealt out by range, sorted within each range and written once; a row's rank is its place in its range plus the
number of rows in the ranges before. Only one row for each range (and group) is summed up in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.shared import materialise

#: monotonically_increasing_id() keeps the partition above this bit and the place within it below.
_SHIFT = 33


def ranged(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """df in order, written, with _place (long): the range and the row's place in it."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    return materialise(placed, label)


def with_rank(placed: DataFrame, name: str, group: str | None = None) -> DataFrame:
    """Replaces _place by the row's rank from 0 among all rows, or among those of its group, whose rows must be adjacent."""
    keys = ["_range", *([group] if group else [])]
    placed = placed.withColumn("_range", F.shiftright("_place", _SHIFT))
    parts = placed.groupBy(*keys).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*([group] if group else [])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    joined = placed.join(parts, keys) if group else placed.join(F.broadcast(parts), keys)  # as many rows as ranges
    return joined.withColumn(name, F.col("_place") - F.col("_first") + F.col("_before")).drop("_place", "_range", "_first", "_before")
