"""Joining annotation files to variants, score matrices and the weights built from them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats.
NULL_SCORES = ("", ".", "NA", "NaN")
COMPLEMENTED = "aPC.LocalDiversity"
ZERO_WHEN_MISSING = "CADD"


def score(text: Column | str) -> Column:
    """The double a score text stands for, null for its missing tokens; use ``bad_scores`` to find anything else."""
    column = F.col(text) if isinstance(text, str) else text
    return F.when(~column.isin(*NULL_SCORES), column.try_cast("double"))


def bad_scores(annotations: DataFrame, name: str) -> DataFrame:
    return annotations.filter(F.col(name).isNotNull() & ~F.col(name).isin(*NULL_SCORES) & F.col(name).try_cast("double").isNull())


def _keyed(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn("_low", F.least(a, b)).withColumn("_high", F.greatest(a, b))


def join_annotations(variants: DataFrame, annotations: DataFrame, fields: Sequence[str], a1: str = "a1", a2: str = "a2", ordered: bool = False) -> DataFrame:
    """Variants with the annotation ``fields`` of their position and alleles, and ``annotation_available``.

    Alleles match in either order, or exactly as (ref, alt) when ``ordered``. Every variant stays.
    """
    kept = annotations.select("pos", a1, a2, *fields, F.lit(True).alias("_found"))
    if ordered:
        left, right, keys = variants, kept.withColumnsRenamed({a1: "ref", a2: "alt"}), ["pos", "ref", "alt"]
    else:
        left, right, keys = _keyed(variants, "ref", "alt"), _keyed(kept, a1, a2).drop(a1, a2), ["pos", "_low", "_high"]
    joined = left.join(right, keys, "left").withColumn("annotation_available", F.coalesce("_found", F.lit(False)))
    return joined.drop("_found", "_low", "_high")


def annotation_problems(variants: DataFrame, annotations: DataFrame, a1: str = "a1", a2: str = "a2", allow_missing_non_snv: bool = False) -> DataFrame:
    """(problem, pos, low, high): alleles annotated more than once, and variants without annotation.

    Missing SNVs are always problems, other variants unless ``allow_missing_non_snv``.
    """
    theirs, ours = _keyed(annotations, a1, a2), _keyed(variants, "ref", "alt")
    key = ["pos", "_low", "_high"]
    repeated = theirs.groupBy(*key).count().filter("count > 1").join(ours.select(*key), key, "left_semi").select(F.lit("repeated").alias("problem"), *key)
    snv = (F.length("ref") == 1) & (F.length("alt") == 1)
    must = ours.filter(snv) if allow_missing_non_snv else ours
    missing = must.join(theirs.select(*key), key, "left_anti").select(F.lit("missing").alias("problem"), *key)
    return repeated.unionByName(missing).withColumnsRenamed({"_low": "low", "_high": "high"})


def coverage(annotated: DataFrame) -> DataFrame:
    """One row: SNVs and other variants, and how many of each have an annotation."""
    snv, there = (F.length("ref") == 1) & (F.length("alt") == 1), F.col("annotation_available")
    return annotated.agg(F.count_if(snv).alias("n_snv"), F.count_if(snv & there).alias("n_snv_annotated"), F.count_if(~snv).alias("n_other"), F.count_if(~snv & there).alias("n_other_annotated"))


def complement(phred: Column) -> Column:
    """-10 log10(1 - 10^(-q/10)); null below 0 (no probability), infinite at 0."""
    rest = 1 - F.pow(F.lit(10.0), -phred / 10)
    return F.when(phred == 0, F.lit(float("inf"))).when(phred > 0, -10 * F.log10(rest))


def rank_of(phred: Column) -> Column:
    """1 - 10^(-q/10)."""
    return 1 - F.pow(F.lit(10.0), -phred / 10)


def phred_columns(available: Sequence[str], wanted: Sequence[str], variant_type: str = "SNV") -> tuple[Column, list[str]]:
    """(array of the wanted scores, their names) in order: unknown names skipped, CADD filled with 0, the complement of
    local diversity behind it; empty for other variant types than SNV."""
    columns, names = [], []
    for name in wanted if variant_type == "SNV" else ():
        if name not in available:
            continue
        value = F.col(f"`{name}`").cast("double")
        columns.append(F.coalesce(value, F.lit(0.0)) if name == ZERO_WHEN_MISSING else value)
        names.append(name)
        if name == COMPLEMENTED:
            columns.append(complement(value))
            names.append(f"{name}(-)")
    return (F.array(*columns) if columns else F.array().cast("array<double>")), names


def association_weights(maf: Column, phred: Column) -> dict[str, Column]:
    """Arrays B, S and A of weights: the base and every score under beta(1,25), then the same under beta(1,1)."""
    w25 = 25 * F.pow(1 - maf, F.lit(24.0))
    ranks = F.concat(F.array(F.lit(1.0)), F.transform(phred, rank_of))
    inverse_density = F.lit(math.pi**2) * maf * (1 - maf)
    both = lambda of: F.concat(F.transform(ranks, lambda r: of(r) * w25), F.transform(ranks, of))
    squares = F.concat(F.transform(ranks, lambda r: r * w25 * w25 * inverse_density), F.transform(ranks, lambda r: r * inverse_density))
    return {"B": both(lambda r: r), "S": both(F.sqrt), "A": squares}
