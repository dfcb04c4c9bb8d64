"""Ordered windows over keys that live long, such as cameras: each key is cut into ranges of its order, which are done side by side; what earlier ranges hand
on is one row a range, put together by a second, small window. No task holds all rows of a key.

``width`` is a range's extent in units of ``order``. Rows whose order or key is null form a range and a key of their own, the order's before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of frame numbers, and of milliseconds.
FRAMES, MILLISECONDS = 10_000, 600_000


def _cut(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("range_", F.floor(F.col(order) / width))


def _handed(cut: DataFrame, handed: DataFrame, by: str) -> DataFrame:
    """cut with its range's row of handed (by, range_, before_). Each range has one; the join is a left one so that only the small side may be broadcast."""
    small = handed.select(F.col(by).alias("by_"), F.col("range_").alias("of_"), "before_")
    return cut.join(small, cut[by].eqNullSafe(small["by_"]) & cut["range_"].eqNullSafe(small["of_"]), "left").drop("by_", "of_")


def previous(df: DataFrame, by: str, order: str, width: int, name: str) -> DataFrame:
    """df with ``name``: the order of the row before; null at a key's first row."""
    cut = _cut(df, order, width)
    ends = cut.groupBy(by, "range_").agg(F.max(order).alias("end_"))
    before = ends.withColumn("before_", F.lag("end_").over(Window.partitionBy(by).orderBy("range_")))
    own = F.lag(order).over(Window.partitionBy(by, "range_").orderBy(order))
    return _handed(cut, before, by).withColumn(name, F.coalesce(own, "before_")).drop("range_", "before_")


def running_sum(df: DataFrame, by: str, order: str, value: Column, width: int, name: str) -> DataFrame:
    """df with ``name``: the sum of value over a key's rows up to and with this one."""
    cut = _cut(df, order, width).withColumn("value_", value.cast("long"))
    sums = cut.groupBy(by, "range_").agg(F.sum("value_").alias("sum_"))
    before = sums.withColumn("before_", F.sum("sum_").over(Window.partitionBy(by).orderBy("range_")) - F.col("sum_"))
    own = F.sum("value_").over(Window.partitionBy(by, "range_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return _handed(cut, before, by).withColumn(name, own + F.col("before_")).drop("range_", "before_", "value_")


def numbered(df: DataFrame, by: str, order: str, width: int, name: str) -> DataFrame:
    """df with ``name``: a row's number in its key, from 1."""
    return running_sum(df, by, order, F.lit(1), width, name)


def carried(df: DataFrame, by: str, order: str, value: str, width: int, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with ``name``: the newest value that is not null, of this row or one before it by order and ties; null where there is none."""
    cut = _cut(df, order, width)
    found = cut.filter(F.col(value).isNotNull()).groupBy(by, "range_").agg(F.max_by(value, F.struct(order, *ties)).alias("end_"))
    ranges = cut.select(F.col(by).alias("by_"), F.col("range_").alias("of_")).distinct()
    every = ranges.join(found, F.col("by_").eqNullSafe(F.col(by)) & F.col("of_").eqNullSafe(F.col("range_")), "left").select(F.col("by_").alias(by), F.col("of_").alias("range_"), "end_")
    earlier = Window.partitionBy(by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    before = every.withColumn("before_", F.last("end_", ignorenulls=True).over(earlier))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(by, "range_").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0))
    return _handed(cut, before, by).withColumn(name, F.coalesce(own, "before_")).drop("range_", "before_")
