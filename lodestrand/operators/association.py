"""Single-variant score tests from sparse calls.

Minor dosages are affine in the stored alternative dosages, so every sum a score test needs comes
from one aggregation of the stored calls per trait and variant, and cells that are not stored enter
through sums over the trait's samples. No genotype matrix is ever built.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import log_erfc
from ..session import broadcast_if_small, stored
from .genotypes import LACKS_CALLED, LACKS_REFERENCE, by_state, frequencies, is_missing, trait_maf
from .null_models import NullModel


def trait_calls(calls: DataFrame, null: NullModel, columns: list[str]) -> DataFrame:
    """Stored calls of each trait's samples with their model columns."""
    return calls.join(broadcast_if_small(null.samples.select("trait", "sample_idx", *columns)), "sample_idx")


def variant_sums(calls: DataFrame, null: NullModel) -> DataFrame:
    """Per trait and variant with stored calls: counts and model sums, then frequencies and orientation.

    The minor dosage of a sample is base + sign * stored dosage, and fill for missing dosages.
    """
    p = null.p
    weights = ["resid", "w", "w1", *(f"wx{i}" for i in range(p))]
    d = F.when(is_missing(), 0.0).otherwise(F.col("state").cast("double"))
    sums = []
    for c in weights:
        sums += [F.sum(d * F.col(c)).alias(f"d_{c}"), F.sum(F.when(is_missing(), F.col(c)).otherwise(0.0)).alias(f"m_{c}")]
    grouped = trait_calls(calls, null, weights).groupBy("trait", "variant_idx").agg(
        F.sum(by_state(LACKS_REFERENCE)).alias("lacks_ref"),
        F.sum(by_state(LACKS_CALLED)).alias("lacks_called"),
        F.count_if(is_missing()).alias("n_missing"),
        F.sum(F.when(is_missing(), 0).otherwise(F.col("state"))).alias("alt_sum"),
        F.sum(d * d * F.col("w")).alias("dd_w"),
        *sums,
    )
    joined = grouped.join(broadcast_if_small(null.models), "trait")
    counted = joined.withColumn("ref_ac", 2 * F.col("n") - F.col("lacks_ref")).withColumn("called", 2 * F.col("n") - F.col("lacks_called")).drop("lacks_ref", "lacks_called")
    return frequencies(counted)


def oriented(sums: DataFrame, imputation: str = "mean") -> DataFrame:
    """Adds base, sign, fill and test_maf."""
    return (
        sums.withColumn("test_maf", trait_maf("reference", imputation))
        .withColumn("base", F.when(F.col("counts_alt"), 0.0).otherwise(2.0))
        .withColumn("sign", F.when(F.col("counts_alt"), 1.0).otherwise(-1.0))
        .withColumn("fill", 2 * F.col("maf") if imputation == "mean" else F.lit(0.0))
    )


def stored_sum(name: str) -> Column:
    """Sum over stored cells of (dosage - base) times a model column."""
    return F.col("sign") * F.col(f"d_{name}") + (F.col("fill") - F.col("base")) * F.col(f"m_{name}")


def quadratic(vector: Column, cov: Column, p: int) -> Column:
    """vector' cov vector, cov as p x p entries by row; the vector is named once, so its expression is not repeated."""
    terms = F.transform(cov, lambda c, k: c * vector[F.floor(k / p).cast("int")] * vector[(k % p).cast("int")])
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def scores(calls: DataFrame, null: NullModel, imputation: str = "mean") -> DataFrame:
    """``variant_sums`` with score (U), cross (C), e_w1 and variance (V), as a stored table."""
    p = null.p
    rows = oriented(variant_sums(calls, null), imputation)
    base, off = F.col("base"), F.col("fill") - F.col("base")
    squares = base * base * F.col("w0") + 2 * base * F.col("e_w1") + F.col("dd_w") + off * off * F.col("m_w") + F.col("between")
    cross = F.array(*(base * F.col("xw0")[i] + stored_sum(f"wx{i}") for i in range(p)))
    rows = rows.withColumn("score", base * F.col("r0") + stored_sum("resid")).withColumn("cross", cross).withColumn("e_w1", stored_sum("w1"))
    if null.pairs is None:
        rows = rows.withColumn("between", F.lit(0.0))
    else:
        rows = stored(rows, "scores")
        cells = oriented_cells(calls, null, rows)
        own = related(cells, null).join(cells.select("trait", "variant_idx", "sample_idx", F.col("e").alias("e2")), ["trait", "variant_idx", "sample_idx"])
        between = own.groupBy("trait", "variant_idx").agg(F.sum(F.col("we") * F.col("e2")).alias("between"))
        rows = rows.join(between, ["trait", "variant_idx"], "left").fillna({"between": 0.0})
    return stored(rows.withColumn("variance", squares - quadratic(F.col("cross"), F.col("cov"), p)), "scores")


def single_variant(calls: DataFrame, null: NullModel, variants: DataFrame, mac_cutoff: float = 20, chunk: int = 5000, imputation: str = "mean") -> DataFrame:
    """Single-variant results of every trait, with the keys that order them.

    Variants need initial_mac >= mac_cutoff and 0 < maf < 1. ``ordinal`` counts a trait's eligible
    variants in position order; results sort by trait, pos, ordinal div chunk, commonness,
    extraction group and variant. P is 1 where the variance is not positive.
    """
    kept = scores(calls, null, imputation).filter(F.col("initial_mac") >= mac_cutoff).filter("maf > 0 and maf < 1")
    rows = kept.join(variants.select("variant_idx", "chrom", "pos", "ref", "alt"), "variant_idx")
    positive = F.col("variance") > 0
    rows = rows.withColumn("score_se", F.when(F.col("variance") >= 0, F.sqrt("variance")))
    rows = rows.withColumn("_deviate", F.abs("score") / F.sqrt(2 * F.when(positive, F.col("variance"))))
    rows = rows.withColumn("log_p", F.when(positive, -log_erfc(F.col("_deviate"))).when(F.col("variance").isNotNull(), 0.0))
    common = (F.col("test_maf") >= 0.01) | (F.col("missing_rate") >= 0.01)
    return _with_ordinals(rows).select(
        "trait", "variant_idx", "chrom", "pos", "ref", "alt", "alt_af", F.col("test_maf").alias("maf"), "n",
        F.exp(-F.col("log_p")).alias("pvalue"), (F.col("log_p") / np.log(10.0)).alias("pvalue_log10"), "score", "score_se",
        F.when(positive, F.col("score") / F.col("variance")).otherwise(0.0).alias("est"), F.when(positive, 1 / F.col("score_se")).otherwise(0.0).alias("est_se"),
        "ordinal", F.floor(F.col("ordinal") / chunk).alias("chunk"), (~common).cast("int").alias("is_rare"), "extraction_group",
    )


#: Positions of one chromosome that are numbered together.
REGION = 10_000_000


def _with_ordinals(rows: DataFrame) -> DataFrame:
    """Running number from 0 in position order per trait, by regions and the counts of earlier regions."""
    keyed = rows.withColumn("region", F.floor(F.col("pos") / REGION))
    counts = keyed.groupBy("trait", "chrom", "region").agg(F.count(F.lit(1)).alias("in_region"))
    earlier = Window.partitionBy("trait", "chrom").orderBy("region").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("trait", "chrom", "region", F.coalesce(F.sum("in_region").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("trait", "chrom", "region").orderBy("pos", "variant_idx")
    return keyed.withColumn("_at", F.row_number().over(inside) - 1).join(broadcast_if_small(before), ["trait", "chrom", "region"]).withColumn("ordinal", F.col("before") + F.col("_at"))


SINGLE_ORDER = ("trait", "chrom", "pos", "chunk", "is_rare", "extraction_group", "variant_idx")


def oriented_cells(calls: DataFrame, null: NullModel, orientation: DataFrame) -> DataFrame:
    """trait, variant_idx, sample_idx, e, w of stored cells whose dosage differs from the base; e is that difference."""
    cells = trait_calls(calls, null, ["w"]).join(orientation.select("trait", "variant_idx", "base", "sign", "fill"), ["trait", "variant_idx"])
    e = F.when(is_missing(), F.col("fill") - F.col("base")).otherwise(F.col("sign") * F.col("state"))
    return cells.select("trait", "variant_idx", "sample_idx", e.alias("e"), "w").filter("e <> 0")


def related(cells: DataFrame, null: NullModel) -> DataFrame:
    """trait, variant_idx, sample_idx, we: products of e with the precision entries between different samples."""
    spread = cells.select("trait", "variant_idx", F.col("sample_idx").alias("i"), "e").join(null.pairs, ["trait", "i"])
    return spread.groupBy("trait", "variant_idx", F.col("j").alias("sample_idx")).agg(F.sum(F.col("e") * F.col("value")).alias("we"))


def weighted_cells(cells: DataFrame, null: NullModel) -> DataFrame:
    """trait, variant_idx, sample_idx, we: e times the whole precision matrix."""
    own = cells.select("trait", "variant_idx", "sample_idx", (F.col("w") * F.col("e")).alias("we"))
    return own if null.pairs is None else own.unionByName(related(cells, null))


def covariance_pairs(cells: DataFrame, members: DataFrame, null: NullModel) -> DataFrame:
    """trait, gene_name, v1 <= v2, pair_sum: products of e under the precision matrix, for variants of the same gene.

    Samples carry few rare variants of one gene, so the self-join on (trait, gene, sample) stays small.
    """
    genes = members.select("gene_name", "variant_idx").distinct()
    left = weighted_cells(cells, null).join(genes, "variant_idx").select("trait", "gene_name", "sample_idx", F.col("variant_idx").alias("v1"), "we")
    right = cells.join(genes, "variant_idx").select("trait", "gene_name", "sample_idx", F.col("variant_idx").alias("v2"), F.col("e").alias("e2"))
    pairs = left.join(right, ["trait", "gene_name", "sample_idx"]).filter("v1 <= v2")
    return pairs.groupBy("trait", "gene_name", "v1", "v2").agg(F.sum(F.col("we") * F.col("e2")).alias("pair_sum"))
