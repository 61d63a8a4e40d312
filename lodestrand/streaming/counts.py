"""Allele counts of calls that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.genotypes import LACKS_CALLED, LACKS_REFERENCE, by_state, is_missing

_CALLS = "sample_idx bigint, variant_idx bigint, state int"


def partial_counts(calls: DataFrame) -> DataFrame:
    """Per variant what its calls take from full reference counts; sums of these over disjoint calls add up."""
    return calls.groupBy("variant_idx").agg(
        F.sum(by_state(LACKS_REFERENCE)).alias("lacks_ref"), F.sum(by_state(LACKS_CALLED)).alias("lacks_called"), F.count_if(is_missing()).alias("n_missing"), F.sum(F.when(is_missing(), 0).otherwise(F.col("state"))).alias("alt_sum")
    )


def start_counting(spark: SparkSession, source: str, output: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Read new call files (Parquet) in ``source`` and keep each batch's partial counts in its own folder of ``output``.

    A batch that runs again after a failure overwrites its folder, so no call counts twice. The
    query takes what is there and ends; run it again for later files.
    """

    def keep(batch: DataFrame, number: int) -> None:
        partial_counts(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    calls = spark.readStream.schema(_CALLS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return calls.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, output: str, n_samples: int) -> DataFrame:
    """variant_idx, ref_ac, called, n_missing, alt_sum, n over all batches so far."""
    sums = spark.read.parquet(output).groupBy("variant_idx").agg(*(F.sum(c).alias(c) for c in ("lacks_ref", "lacks_called", "n_missing", "alt_sum")))
    full = F.lit(2 * n_samples)
    return sums.select("variant_idx", (full - F.col("lacks_ref")).alias("ref_ac"), (full - F.col("lacks_called")).alias("called"), "n_missing", "alt_sum", F.lit(n_samples).cast("bigint").alias("n"))
