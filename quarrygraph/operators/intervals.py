"""Joins of points with the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = "__bin"


def binned_points(points: DataFrame, point: Column, width: int) -> DataFrame:
    """Points with the bin, ``width`` wide, in which they lie."""
    return points.withColumn(BIN, F.floor(point / F.lit(width)))


def binned_intervals(intervals: DataFrame, low: Column, high: Column, width: int) -> DataFrame:
    """Intervals once for each bin they touch; ones that end before they begin touch none."""
    first, last = F.floor(low / F.lit(width)), F.floor(high / F.lit(width))
    return intervals.where(low <= high).withColumn(BIN, F.explode(F.sequence(first, last)))


def holding(points: DataFrame, intervals: DataFrame, keys: Column, inside: Column, point: Column, low: Column, high: Column, width: int, how: str = "inner") -> DataFrame:
    """points join intervals on ``keys`` (an equality) and ``inside``, which must imply low <= point <= high.

    A point has one bin, so every pair meets once; the bin is part of the join key, so a key with many rows is spread
    over tasks and its points meet only the intervals near them, not all of the key's.
    """
    p, i = binned_points(points, point, width), binned_intervals(intervals, low, high, width).withColumnRenamed(BIN, "__interval_bin")
    return p.join(i, keys & (F.col(BIN) == F.col("__interval_bin")) & inside, how).drop(BIN, "__interval_bin")
