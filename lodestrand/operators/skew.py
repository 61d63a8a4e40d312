"""Joins and numbering that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small

#: Keys are counted in this many hash buckets.
BUCKETS = 1 << 16
#: Rows of one key that a task takes; a bucket above them is split, into as many parts as it holds this many rows.
ROWS_PER_TASK = 500_000
#: Buckets that are split at most: on tables beyond MAX_HOT * ROWS_PER_TASK rows a task takes a MAX_HOT-th of all rows.
MAX_HOT = 4096


def key_bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def hot_buckets(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> dict[int, int]:
    """Hash buckets of ``keys`` with more rows than a task should take, and the number of salts each needs.

    A key with more rows than that always lies in one of them. At most MAX_HOT buckets with fewer
    than 2 * MAX_HOT salts together come back, whatever the data: only BUCKETS counters are aggregated.
    """
    counts = df.groupBy(key_bucket(keys).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # over the counters
    limit = F.greatest(F.lit(rows_per_task), F.sum("n").over(whole) / MAX_HOT)
    rows = counts.withColumn("limit", limit).filter("n > limit").select("bucket", F.ceil(F.col("n") / F.col("limit")).cast("int").alias("salts")).collect()
    return {r["bucket"]: r["salts"] for r in rows}


def _salts(df: DataFrame, keys: Sequence[str], hot: dict[int, int], name: str) -> DataFrame:
    """``df`` with the number of salts of its key (1 outside hot buckets)."""
    table = df.sparkSession.createDataFrame(list(hot.items()), "_bucket int, _salts int")
    joined = df.withColumn("_bucket", key_bucket(keys)).join(F.broadcast(table), "_bucket", "left")  # at most MAX_HOT rows
    return joined.withColumn(name, F.coalesce("_salts", F.lit(1))).select(*df.columns, name)


def salted(df: DataFrame, keys: Sequence[str], hot: dict[int, int], spread: Column, name: str) -> DataFrame:
    """``df`` with a salt from ``spread``: 0 for rows outside hot buckets, else one of the bucket's."""
    if not hot:
        return df.withColumn(name, F.lit(0))
    return _salts(df, keys, hot, name).withColumn(name, F.pmod(F.xxhash64(spread), F.col(name)).cast("int"))


def with_all_salts(df: DataFrame, keys: Sequence[str], hot: dict[int, int], name: str) -> DataFrame:
    """One copy of each row per salt its key can have; one outside hot buckets."""
    if not hot:
        return df.withColumn(name, F.lit(0))
    return _salts(df, keys, hot, name).withColumn(name, F.explode(F.sequence(F.lit(0), F.col(name) - 1)))


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Equi-join of a large, possibly skewed ``left`` with a ``right`` of few rows per key.

    A ``right`` of counted small size is broadcast. Otherwise rows of hot buckets are spread over
    as many tasks as their number asks for, and the matching right rows are repeated for each.
    ``how`` is inner, left, left_semi or left_anti. Null keys match nothing.
    """
    right_small = broadcast_if_small_rows(right)
    if right_small is not None:
        return left.join(right_small, list(keys), how)
    hot = hot_buckets(left, keys, rows_per_task)
    if not hot:
        return left.join(right, list(keys), how)
    spread = salted(left, keys, hot, F.struct(*left.columns), "_salt")
    return spread.join(with_all_salts(right, keys, hot, "_salt"), [*keys, "_salt"], how).drop("_salt")


def broadcast_if_small_rows(df: DataFrame) -> DataFrame | None:
    """``df`` with a broadcast hint where its counted size allows it, else None."""
    return F.broadcast(df) if small(df) else None
