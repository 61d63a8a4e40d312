"""Average ranks and rank-based inverse normal values without a window over a whole trait."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import normal_quantile
from ..session import broadcast_if_small, stored
from .skew import skew_join


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``df`` with rank (ties share their mean) and n per key; rows with a null key or value are left out.

    Equal values merge into counts, the counts are range-sorted once, and counts of earlier
    partitions turn positions inside a partition into ranks.
    """
    keys = list(keys)
    present = df.dropna(subset=[*keys, value])
    counts = present.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ordered = stored(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "ranks")
    parts = ordered.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in_part"))
    by_part = Window.partitionBy(*keys).orderBy("_part")
    parts = parts.withColumn("_before", F.sum("_in_part").over(by_part) - F.col("_in_part")).withColumn("n", F.sum("_in_part").over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(*keys, "_part").orderBy("_v")
    ranks = (
        ordered.withColumn("_upto", F.sum("_n").over(inside))
        .join(broadcast_if_small(parts.drop("_in_part")), [*keys, "_part"])
        .select(*keys, "_v", (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"), "n")
    )
    matched = skew_join(present.withColumn("_v", F.col(value) + F.lit(0.0)), ranks.withColumn("_v", F.col("_v") + F.lit(0.0)), [*keys, "_v"])
    return matched.drop("_v")


def inverse_normal(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``average_ranks`` with rint, the normal quantile of (rank - 3/8) / (n + 1/4)."""
    return average_ranks(df, keys, value).withColumn("rint", normal_quantile((F.col("rank") - 0.375) / (F.col("n") + 0.25)))
