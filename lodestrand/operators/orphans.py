"""References to records that are missing, deleted or arrive later.

Parent keys are integers: sample indices, or the microseconds at which an individual is valid.
Either way sorted parent keys shrink to contiguous runs, a reference is matched as of the last run
that starts at or before it, and it is an orphan when it lies beyond that run's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import hot_buckets, salted, skew_join, with_all_salts

#: Integer keys are sorted in blocks of 2**BLOCK_BITS, which bounds every sorted group.
BLOCK_BITS = 16
#: References of one individual that one task sorts; beyond them they are salted.
ROWS_PER_TASK = 100_000
_FOREVER = 2**62


def key_runs(parents: DataFrame, key: str) -> DataFrame:
    """(block, run_start, run_end): the contiguous runs of the different keys, cut at block borders.

    ``key`` is a bigint; nulls are ignored, repeats count once, an empty table has no runs.
    """
    keys = parents.select(F.col(key).cast("bigint").alias("k")).dropna().distinct().withColumn("block", F.shiftright("k", BLOCK_BITS))
    island = F.col("k") - F.row_number().over(Window.partitionBy("block").orderBy("k"))
    return keys.withColumn("island", island).groupBy("block", "island").agg(F.min("k").alias("run_start"), F.max("k").alias("run_end")).drop("island")


def keys_beyond_runs(references: DataFrame, key: str, runs: DataFrame) -> DataFrame:
    """(key): the different non-null reference keys that no run holds."""
    wanted = references.select(F.col(key).cast("bigint").alias("k")).dropna().distinct()
    events = wanted.select(F.shiftright("k", BLOCK_BITS).alias("block"), "k", F.lit(None).cast("bigint").alias("run_end")).unionByName(
        runs.select("block", F.col("run_start").alias("k"), "run_end")
    )
    as_of = Window.partitionBy("block").orderBy("k", F.col("run_end").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ends = events.withColumn("end", F.last("run_end", ignorenulls=True).over(as_of))
    return ends.filter("run_end is null and (end is null or k > end)").select(F.col("k").alias(key))


def validity_runs(fam: DataFrame) -> DataFrame:
    """(fid, iid, run_start, run_end) in microseconds: when each individual is valid, as disjoint runs.

    A row holds from loaded_at until before deleted_at; touching and overlapping rows join into one
    run. A row deleted no later than loaded leaves an empty run (end before start), which still
    shows that the individual was loaded; one never loaded (null loaded_at) starts beyond all times.
    Rows with a null fid or iid are no individuals.
    """
    start = F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(_FOREVER))
    end = F.coalesce(F.unix_micros(F.col("deleted_at").cast("timestamp")) - 1, F.lit(_FOREVER))
    rows = fam.select("fid", "iid", start.alias("s"), F.greatest(end, start - 1).alias("e")).dropna().groupBy("fid", "iid", "s").agg(F.max("e").alias("e"))
    by_start = Window.partitionBy("fid", "iid").orderBy("s")
    before = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    new_run = F.when(F.col("s") <= before + 1, 0).otherwise(1)
    return (
        rows.withColumn("new", new_run)
        .withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("fid", "iid", "run")
        .agg(F.min("s").alias("run_start"), F.max("e").alias("run_end"))
        .drop("run")
    )


def individual_orphans(references: DataFrame, runs: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """table_name, row_key, period_month, status of references (table_name, row_key, fid, iid, loaded_at) to no valid individual.

    References and runs of an individual meet in one sorted group and the last run starting no
    later than the reference decides; individuals with very many references are salted, their few
    runs repeated. A null fid or iid refers to nobody. A null loaded_at is judged by existence alone.
    """
    pair = ["fid", "iid"]
    t = F.unix_micros(F.col("loaded_at").cast("timestamp"))
    refs = references.select("table_name", "row_key", *pair, t.alias("t"), F.date_format("loaded_at", "yyyy-MM").alias("period_month")).dropna(subset=pair)
    hot = hot_buckets(refs, pair, rows_per_task)
    asked = salted(refs, pair, hot, F.struct("table_name", "row_key", "t"), "salt").withColumn("run_end", F.lit(None).cast("bigint"))
    known = with_all_salts(runs, pair, hot, "salt").select(
        F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("bigint").alias("row_key"), *pair, F.col("run_start").alias("t"), F.lit(None).cast("string").alias("period_month"), "salt", "run_end"
    )
    group = Window.partitionBy(*pair, "salt")
    as_of = group.orderBy("t", F.col("run_end").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    judged = (
        asked.unionByName(known)
        .withColumn("exists", F.max(F.col("run_end").isNotNull()).over(group))
        .withColumn("end", F.last("run_end", ignorenulls=True).over(as_of))
        .filter(F.col("table_name").isNotNull())
    )
    status = F.when(~F.col("exists"), "missing").when(F.col("t").isNull(), None).when(F.col("end").isNull(), "late").when(F.col("t") > F.col("end"), "deleted")
    return judged.select("table_name", "row_key", "period_month", status.alias("status")).filter("status is not null").distinct()


def edge_orphans(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """table_name, row_key, period_month, status of edges with an end that is no sample_index; null ends refer to nobody."""
    ends = edges.select("edge_id", "loaded_at", F.explode(F.array("edge_rows", "edge_cols")).alias("end"))
    beyond = keys_beyond_runs(ends, "end", key_runs(samples, "sample_index"))
    lost = skew_join(ends, beyond, ["end"], "left_semi")
    return lost.select(F.lit("kinship_edges").alias("table_name"), F.col("edge_id").alias("row_key"), F.date_format("loaded_at", "yyyy-MM").alias("period_month"), F.lit("missing").alias("status")).distinct()


def person_references(phenotypes: DataFrame, covariates: DataFrame, samples: DataFrame) -> DataFrame:
    def of(df: DataFrame, name: str, key: str, fid: Column, iid: Column) -> DataFrame:
        return df.select(F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("row_key"), fid.alias("fid"), iid.alias("iid"), "loaded_at")

    pair = F.from_json("sample_id", "array<string>")
    return (
        of(phenotypes, "phenotypes", "row_id", F.col("fid"), F.col("iid"))
        .unionByName(of(covariates, "covariates", "row_id", F.col("fid"), F.col("iid")))
        .unionByName(of(samples, "kinship_samples", "sample_index", F.get(pair, F.lit(0)), F.get(pair, F.lit(1))))
    )
