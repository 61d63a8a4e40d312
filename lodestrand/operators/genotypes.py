"""Allele counts, frequencies and dosages from sparse six-state calls.

Calls hold one row per sample and variant whose state is not 0: 1 and 2 alternative alleles, 3 a
missing call, 4 and 5 half calls of a reference or alternative allele. What is not stored is
homozygous reference, so every sum starts from its full value and subtracts what calls change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# By state, how many reference and called alleles a call lacks.
LACKS_REFERENCE = (0, 1, 2, 2, 1, 2)
LACKS_CALLED = (0, 0, 0, 2, 1, 1)
COMMON_MAF = 0.01
COMMON_MISSING = 0.01


def by_state(values: tuple[int, ...], state: Column | str = "state") -> Column:
    column = F.col(state) if isinstance(state, str) else state
    return F.element_at(F.array(*map(F.lit, values)), column + 1)


def is_missing(state: Column | str = "state") -> Column:
    """Whether the dosage is unknown: missing and half calls."""
    column = F.col(state) if isinstance(state, str) else state
    return column >= 3


def allele_counts(calls: DataFrame, n_samples: Column | int, keys: tuple[str, ...] = ("variant_idx",)) -> DataFrame:
    """Per key: ref_ac, called (alleles), n_missing (dosages) and alt_sum (alternative alleles in called dosages) over ``n_samples``."""
    n = n_samples if isinstance(n_samples, Column) else F.lit(n_samples)
    total = (2 * n).cast("bigint")
    return calls.groupBy(*keys).agg(
        (F.first(total) - F.sum(by_state(LACKS_REFERENCE))).alias("ref_ac"),
        (F.first(total) - F.sum(by_state(LACKS_CALLED))).alias("called"),
        F.count_if(is_missing()).alias("n_missing"),
        F.sum(F.when(is_missing(), 0).otherwise(F.col("state"))).alias("alt_sum"),
        F.first(n).cast("bigint").alias("n"),
    )


def complete(counts: DataFrame, variants: DataFrame, n_samples: int) -> DataFrame:
    """Counts for every variant; those without stored calls are wholly reference."""
    full = {"ref_ac": 2 * n_samples, "called": 2 * n_samples, "n_missing": 0, "alt_sum": 0, "n": n_samples}
    return variants.select("variant_idx").join(counts, "variant_idx", "left").fillna(full)


def frequencies(counts: DataFrame) -> DataFrame:
    """Adds ref_af, missing_rate, alt_ac, initial_mac, maf, counts_alt, alt_af, extraction_group and observed_mac.

    Frequencies are null where nothing is called. Ties of the two alleles count the alternative one.
    """
    ref_af = F.when(F.col("called") > 0, F.col("ref_ac") / F.col("called"))
    missing_rate = (2 * F.col("n") - F.col("called")) / (2 * F.col("n"))
    alt_ac = 2 * F.rint(F.col("n") * (1 - F.col("missing_rate"))) - F.col("ref_ac")
    common = (F.col("maf") >= COMMON_MAF) | (F.col("missing_rate") >= COMMON_MISSING)
    observed = F.when(F.col("counts_alt"), F.col("alt_sum")).otherwise(2 * (F.col("n") - F.col("n_missing")) - F.col("alt_sum"))
    return (
        counts.withColumn("ref_af", ref_af)
        .withColumn("missing_rate", missing_rate)
        .withColumn("alt_ac", F.when(F.col("called") > 0, alt_ac))
        .withColumn("initial_mac", F.when(F.col("called") > 0, F.least("alt_ac", F.col("ref_ac").cast("double"))))
        .withColumn("alt_af", 1 - F.col("ref_af"))
        .withColumn("maf", F.least("ref_af", "alt_af"))
        .withColumn("counts_alt", F.col("ref_af") >= 0.5)
        .withColumn("extraction_group", F.when(F.col("alt_af") > 0.5, 2).when(common, 1).otherwise(0))
        .withColumn("observed_mac", observed)
    )


def trait_maf(mode: str = "reference", imputation: str = "mean") -> Column:
    """The frequency a trait's tests use, from the columns of ``frequencies``.

    Mode reference takes the smaller allele frequency, count the observed minor alleles over the
    called dosages. Minor imputation fills with zero, so it divides by all samples.
    """
    n = F.col("n")
    if mode == "reference":
        restored = F.rint(2 * F.col("maf") * (1 - F.col("missing_rate")) * n) / (2 * n)
        return F.col("maf") if imputation == "mean" else restored
    dosages = n - F.col("n_missing") if imputation == "mean" else n
    return F.when(dosages > 0, F.col("observed_mac") / (2 * dosages))


def cumulative_mac(maf: str = "maf", imputation: str = "mean") -> Column:
    """Sum of a variant's imputed minor dosages; a mask's cMAC is the sum of these."""
    filled = F.col("n_missing") * 2 * F.col(maf) if imputation == "mean" else F.lit(0.0)
    return F.col("observed_mac") + filled


def safe_mac_bound() -> Column:
    """An upper bound, from whole-axis counts, of the initial MAC in any subset of the samples."""
    return F.least(F.col("ref_ac"), F.col("called") - F.col("ref_ac") + 1)


def subset_counts(calls: DataFrame, members: DataFrame, n_members: int) -> DataFrame:
    """Allele counts over the samples of ``members`` (sample_idx) only."""
    return allele_counts(calls.join(members.select("sample_idx").distinct(), "sample_idx", "left_semi"), n_members)


def minor_dosages(calls: DataFrame, stats: DataFrame, imputation: str = "mean") -> DataFrame:
    """variant_idx, sample_idx, dosage of the minor allele for every stored call; missing ones imputed.

    Where the reference allele is the minor one, samples without a stored call have dosage 2.
    """
    filled = 2 * F.col("maf") if imputation == "mean" else F.lit(0.0)
    alt = F.col("state").cast("double")
    dosage = F.when(is_missing(), filled).when(F.col("counts_alt"), alt).otherwise(2 - alt)
    return calls.join(stats.select("variant_idx", "maf", "counts_alt"), "variant_idx").select("variant_idx", "sample_idx", dosage.alias("dosage"))
