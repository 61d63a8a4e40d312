"""Sample identities: exact (FID, IID) pairs and their keys; alignment of inputs on the sample axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rejects import bad_identifier

LEGACY_ID = r"\A[1-9][0-9]*\z"


def sample_key(fid: str, iid: str) -> Column:
    """The compact JSON array ["FID","IID"]; null if either is null."""
    return F.when(F.col(fid).isNotNull() & F.col(iid).isNotNull(), F.to_json(F.array(fid, iid)))


def split_key(key: str) -> Column:
    """struct(fid, iid) of a key in its one valid spelling, else null."""
    pair = F.from_json(F.col(key), "array<string>")
    again = F.to_json(F.array(pair[0], pair[1]))
    good = (F.size(pair) == 2) & (again == F.col(key))
    return F.when(F.coalesce(good, F.lit(False)), F.struct(pair[0].alias("fid"), pair[1].alias("iid")))


def axis_problems(axis: DataFrame, fid: str = "fid", iid: str = "iid") -> DataFrame:
    """(fid, iid, problem) of pairs that cannot identify a sample: identifier (empty, blanks or control characters) or repeated."""
    bad = axis.filter(bad_identifier(F.col(fid)) | bad_identifier(F.col(iid))).select(fid, iid, F.lit("identifier").alias("problem"))
    repeated = axis.groupBy(fid, iid).count().filter("count > 1").select(fid, iid, F.lit("repeated").alias("problem"))
    return bad.distinct().unionByName(repeated)


def align(axis: DataFrame, phenotypes: DataFrame, covariates: DataFrame, key: str, trait: str, covariate_names: list[str]) -> DataFrame:
    """Axis rows with ``trait`` and all covariates present, as (axis columns, y, covariates); never imputed.

    Keys join exactly and are unique on every side. The axis columns keep their order index for sorting.
    """
    y = phenotypes.select(key, F.col(trait).alias("y"))
    x = covariates.select(key, *covariate_names)
    return axis.join(y, key).join(x, key).dropna(subset=["y", *covariate_names])


def with_presence(axis: DataFrame, values: DataFrame, key: str, names: list[str]) -> DataFrame:
    """All axis rows with the values joined by key and ``present``, whether the key occurs among them."""
    marked = values.select(key, *names, F.lit(True).alias("_here"))
    return axis.join(marked, key, "left").withColumn("present", F.coalesce("_here", F.lit(False))).drop("_here")


def alignment_counts(axis: DataFrame, phenotypes: DataFrame, covariates: DataFrame, key: str, trait: str, covariate_names: list[str]) -> DataFrame:
    """One row: matched samples, axis samples left out, and phenotype rows whose key is not on the axis."""
    matched = align(axis, phenotypes, covariates, key, trait, covariate_names).agg(F.count(F.lit(1)).alias("n_matched"))
    total = axis.agg(F.count(F.lit(1)).alias("n_axis"))
    absent = phenotypes.join(axis.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_absent"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  each side is a single row
    return one(matched).join(one(total), "_one").join(one(absent), "_one").select("n_matched", (F.col("n_axis") - F.col("n_matched")).alias("n_excluded"), "n_absent")


def quality_summary(long: DataFrame) -> DataFrame:
    """Per trait of (trait, y): rows, missing, least, greatest, whether all values are 0 or 1 (then a binary trait), cases, controls."""
    binary = F.bool_and(F.col("y").isin(0.0, 1.0))
    return long.groupBy("trait").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("y").isNull()).alias("n_missing"),
        F.min("y").alias("least"),
        F.max("y").alias("greatest"),
        F.when(binary, "binomial").otherwise("gaussian").alias("family"),
        F.when(binary, F.count_if(F.col("y") == 1)).alias("n_cases"),
        F.when(binary, F.count_if(F.col("y") == 0)).alias("n_controls"),
    )


def union_in_order(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Keys of both, each once, with ``ordinal`` from their first appearance (all of the first come before the second)."""
    both = first.select(key, F.struct(F.lit(0).alias("side"), F.col(order).alias("at")).alias("ordinal")).unionByName(second.select(key, F.struct(F.lit(1).alias("side"), F.col(order).alias("at")).alias("ordinal")))
    return both.groupBy(key).agg(F.min("ordinal").alias("ordinal"))


def select_cohort(axis: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Axis rows whose key is among the members; the axis order index is untouched."""
    return axis.join(members.select(key).distinct(), key, "left_semi")
