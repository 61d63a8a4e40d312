"""Points in intervals by binned equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import skew_join

BIN = 10_000


def merged(intervals: DataFrame, by: str = "chrom", start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """Disjoint closed intervals covering the same integer positions; rows with start beyond end or nulls are left out."""
    before = Window.partitionBy(by).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(by).orderBy(start).rowsBetween(Window.unboundedPreceding, 0)
    return (
        intervals.filter(F.col(start) <= F.col(end))
        .groupBy(by, start)
        .agg(F.max(end).alias(end))
        .withColumn("_new", F.when(F.col(start) <= F.max(end).over(before) + 1, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(upto))
        .groupBy(by, "_run")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_run")
    )


def range_join(points: DataFrame, intervals: DataFrame, by: str = "chrom", pos: str = "pos", start: str = "start_pos", end: str = "end_pos", how: str = "inner", bin_size: int = BIN) -> DataFrame:
    """Points with the closed intervals that hold them (inner), or just the points in any (left_semi).

    Intervals repeat for each bin they touch, so that bins join by equality and the exact test
    filters inside. A point meets an interval in one bin only, so no pair repeats. Null keys match nothing.
    """
    if how == "left_semi":
        intervals = merged(intervals, by, start, end).select(by, start, end)
    at = points.withColumn("_bin", F.floor(F.col(pos) / bin_size))
    bins = F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))
    spread = intervals.filter(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(bins))
    found = skew_join(at, spread, [by, "_bin"]).filter(F.col(pos).between(F.col(start), F.col(end))).drop("_bin")
    return found.select(*points.columns) if how == "left_semi" else found
