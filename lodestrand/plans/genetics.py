"""Queries of the association operators over the genotype view of the star schema, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.combine import cauchy
from ..functions.normal import normal_quantile_sql
from ..operators import annotations, association, genotypes, identity, joint, kinship, masks, null_models, ranges, ranking, set_tests
from ..session import shared_dir, stored, table
from ..sources import files, star
from ..streaming import counts

NAMES = ["CADD", "aPC.LocalDiversity"]


def _r(name: str, digits: int = 6) -> F.Column:
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = star.samples(spark, sf_dir)
    n = axis.count()
    counts = genotypes.allele_counts(star.calls(spark, sf_dir), n)
    return genotypes.frequencies(genotypes.complete(counts, star.variants(spark, sf_dir), n))


def variant_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele counts, frequencies, orientation and extraction group of every variant over all samples."""
    s = _stats(spark, sf_dir)
    return s.select("variant_idx", "ref_ac", "called", "n_missing", _r("ref_af", 9), _r("missing_rate", 9), F.col("initial_mac").cast("bigint").alias("initial_mac"), _r("maf", 9), "counts_alt", "extraction_group", F.col("observed_mac").cast("bigint").alias("observed_mac"), F.round(genotypes.cumulative_mac(), 6).alias("cmac"))


def variant_stats_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts over the samples of one segment only, and the frequencies each mode and imputation gives."""
    members = identity.select_cohort(star.samples(spark, sf_dir), star.samples(spark, sf_dir).filter("segment = 'BUILDING'"), "sample_idx")
    n = members.count()
    counts = genotypes.subset_counts(star.calls(spark, sf_dir), members, n)
    s = genotypes.frequencies(genotypes.complete(counts, star.variants(spark, sf_dir), n))
    modes = [F.round(genotypes.trait_maf(mode, imp), 9).alias(f"{mode}_{imp}") for mode in ("reference", "count") for imp in ("mean", "minor")]
    return s.select("variant_idx", "ref_ac", "called", "n_missing", F.col("initial_mac").cast("bigint").alias("initial_mac"), *modes)


def mac_prescreen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants that whole-axis counts alone keep in play for any subset of samples at a MAC of 20."""
    s = _stats(spark, sf_dir).withColumn("bound", genotypes.safe_mac_bound())
    return s.filter("bound >= 20").select("variant_idx", "bound")


def minor_dosages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored minor dosages with missing ones filled: per variant their number and sum."""
    d = genotypes.minor_dosages(star.calls(spark, sf_dir), _stats(spark, sf_dir))
    return d.groupBy("variant_idx").agg(F.count(F.lit(1)).alias("n_stored"), F.round(F.sum("dosage"), 6).alias("dosage_sum"))


def sample_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample keys and the pairs they decode to."""
    keyed = star.samples(spark, sf_dir).withColumn("pair", identity.split_key("sample_key"))
    return keyed.select("sample_idx", "sample_key", F.col("pair.fid").alias("fid"), F.col("pair.iid").alias("iid"))


def sample_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete cases of the trait balance on the sample axis."""
    return identity.align(star.samples(spark, sf_dir).select("sample_idx"), star.traits(spark, sf_dir), star.covariates(spark, sf_dir), "sample_idx", "balance", ["nation", "n_orders"])


def alignment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = star.samples(spark, sf_dir).filter("segment <> 'MACHINERY'").select("sample_idx")
    return identity.alignment_counts(axis, star.traits(spark, sf_dir), star.covariates(spark, sf_dir), "sample_idx", "balance", ["nation", "n_orders"])


def presence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples with the order count of those that have orders."""
    have = star.covariates(spark, sf_dir).filter("n_orders is not null")
    return identity.with_presence(star.samples(spark, sf_dir).select("sample_idx"), have, "sample_idx", ["n_orders"])


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = star.traits(spark, sf_dir).unpivot(["sample_idx"], ["balance", "building"], "trait", "y")
    return identity.quality_summary(long)


def annotation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with their annotation in either allele order; missing score tokens are null."""
    joined = annotations.join_annotations(star.variants(spark, sf_dir), star.raw_annotations(spark, sf_dir), ["score"])
    return joined.select("variant_idx", "annotation_available", annotations.score("score").alias("score"))


def annotation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.coverage(annotations.join_annotations(star.variants(spark, sf_dir), star.raw_annotations(spark, sf_dir), ["score"]))


def annotation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles annotated twice (every fifth row is, here) and SNVs without annotation."""
    raw = star.raw_annotations(spark, sf_dir)
    twice = raw.unionByName(raw.filter("pos % 5 = 1"))
    return annotations.annotation_problems(star.variants(spark, sf_dir), twice, allow_missing_non_snv=True)


def annotation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every weight of every rare variant, in long form."""
    phred, _ = _phred()
    rows = star.variants(spark, sf_dir).select("variant_idx", phred.alias("phred")).join(_stats(spark, sf_dir).filter("maf > 0 and maf < 0.01").select("variant_idx", "maf"), "variant_idx")
    kinds = F.create_map(*(x for k, w in annotations.association_weights(F.col("maf"), F.col("phred")).items() for x in (F.lit(k), w)))
    long = rows.select("variant_idx", F.explode(kinds).alias("kind", "weights")).select("variant_idx", "kind", F.posexplode("weights").alias("at", "weight"))
    return long.select("variant_idx", "kind", "at", _r("weight", 9))


def _phred() -> tuple[F.Column, list[str]]:
    phred, names = annotations.phred_columns(["CADD", "aPC.LocalDiversity"], [*NAMES, "unknown"])
    return F.array(F.coalesce("cadd", F.lit(0.0)), F.col("local_diversity"), annotations.complement(F.col("local_diversity"))), names


def gene_span_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants within the closed spans of genes widened by 35 positions, so that spans overlap."""
    wide = star.genes(spark, sf_dir).select("gene_name", "chrom", (F.col("start_pos") - 35).alias("start_pos"), (F.col("end_pos") + 35).alias("end_pos"))
    return ranges.range_join(star.variants(spark, sf_dir).select("variant_idx", "chrom", "pos"), wide).select("gene_name", "variant_idx")


def promoter_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants in the union of all promoter intervals; chromosome names match in any spelling."""
    spelled = star.promoters(spark, sf_dir).select(masks.chromosome(F.concat(F.lit("cHr"), "chrom")).alias("chrom"), "start_pos", "end_pos")
    return ranges.range_join(star.variants(spark, sf_dir), spelled, how="left_semi").select("variant_idx")


def coding_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.coding_masks(star.variants(spark, sf_dir), star.genes(spark, sf_dir))


def ptv_masks_all_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protein-truncating masks over SNVs and indels together."""
    return masks.coding_masks(star.variants(spark, sf_dir), star.genes(spark, sf_dir), "variant").filter("mask in ('ptv', 'ptv_ds')")


def noncoding_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.noncoding_masks(star.variants(spark, sf_dir), star.promoters(spark, sf_dir), star.genes(spark, sf_dir))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding_masks(spark, sf_dir).unionByName(noncoding_masks(spark, sf_dir))


def mask_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.mask_sizes(_members(spark, sf_dir))


def rare_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare members of masks that have two to six of them."""
    return masks.rare(_members(spark, sf_dir), _stats(spark, sf_dir), at_most=6)


def distinct_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks and the first mask with the same variants."""
    return masks.distinct_masks(_members(spark, sf_dir))


def rint_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks and inverse normal values of both traits."""
    long = star.traits(spark, sf_dir).unpivot(["sample_idx"], ["balance", "building"], "trait", "y")
    return ranking.inverse_normal(long, ["trait"], "y").select("trait", "sample_idx", "rank", "n", _r("rint", 9))


def _linear(spark: SparkSession, sf_dir: str) -> null_models.NullModel:
    return null_models.fit_linear(star.design(spark, sf_dir).filter("trait = 'balance'"), 3)


def _logistic(spark: SparkSession, sf_dir: str) -> null_models.NullModel:
    return null_models.fit_logistic(star.design(spark, sf_dir).filter("trait = 'building'"), 3)


def null_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear null model of balance."""
    return _linear(spark, sf_dir).models.select("trait", "n", F.round(F.col("beta")[0], 6).alias("b0"), F.round(F.col("beta")[1], 6).alias("b1"), F.round(F.col("beta")[2], 6).alias("b2"), F.round("sigma2", 3).alias("sigma2"))


def null_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logistic null model of building and how far its score equations are from zero."""
    m = _logistic(spark, sf_dir)
    gap = m.samples.groupBy("trait").agg(*(F.sum(F.col(f"x{i}") * F.col("resid")).alias(f"s{i}") for i in range(3)))
    worst = F.greatest(*(F.abs(F.col(f"s{i}")) for i in range(3))) < 1e-4
    return m.models.join(gap, "trait").select("trait", "n", *(F.round(F.col("beta")[i], 6).alias(f"b{i}") for i in range(3)), worst.alias("at_optimum"))


def residual_rint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """balance after its covariates: inverse normal values of the residuals on the original scale."""
    return null_models.residual_inverse_normal(star.design(spark, sf_dir).filter("trait = 'balance'"), 3).select("sample_idx", _r("y", 6))


def single_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-variant score tests of balance; p-values enter by their normal deviate and log."""
    rows = association.single_variant(star.calls(spark, sf_dir), _linear(spark, sf_dir), star.variants(spark, sf_dir), chunk=500)
    z = F.round(F.col("score") / F.col("score_se"), 6) + F.lit(0.0)
    return rows.select("variant_idx", "pos", "ref", "alt", _r("alt_af", 9), _r("maf", 9), "n", z.alias("z"), _r("est", 4), _r("est_se", 4), "ordinal", "chunk", "is_rare", "extraction_group")


def single_variant_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values of the single-variant tests of balance."""
    rows = association.single_variant(stored(star.calls(spark, sf_dir), "calls"), _linear(spark, sf_dir), star.variants(spark, sf_dir))
    return rows.select("variant_idx", _r("pvalue", 8), _r("pvalue_log10", 4))


def binary_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-variant tests of building in result order, by saddlepoint where nominally significant."""
    calls, null = stored(star.calls(spark, sf_dir), "calls"), _logistic(spark, sf_dir)
    rows = association.single_variant(calls, null, star.variants(spark, sf_dir))
    spa = set_tests.binary_single(calls, null).select("trait", "variant_idx", F.col("p").alias("p_spa"), "unverified")
    return rows.join(spa, ["trait", "variant_idx"], "left").orderBy(*association.SINGLE_ORDER).select(*association.SINGLE_ORDER, "pvalue", "p_spa", "unverified")


def binary_single_nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and normal-theory p-values of building's single-variant tests."""
    calls, null = stored(star.calls(spark, sf_dir), "calls"), _logistic(spark, sf_dir)
    rows = association.single_variant(calls, null, star.variants(spark, sf_dir))
    z = F.round(F.col("score") / F.col("score_se"), 5) + F.lit(0.0)
    return rows.select("variant_idx", z.alias("z"), _r("pvalue", 6), _r("pvalue_log10", 4))


def single_two_chromosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-variant tests of balance where every second variant lies on a second chromosome, at positions of its own; numbered within chromosomes."""
    second = F.col("variant_idx") % 2 == 1
    variants = star.variants(spark, sf_dir).withColumn("chrom", F.when(second, "22").otherwise("21")).withColumn("pos", F.when(second, F.lit(100_000_000) - F.col("pos")).otherwise(F.col("pos")))
    rows = association.single_variant(stored(star.calls(spark, sf_dir), "calls"), _linear(spark, sf_dir), variants, chunk=500)
    z = F.round(F.col("score") / F.col("score_se"), 6) + F.lit(0.0)
    return rows.select("variant_idx", "chrom", "pos", z.alias("z"), "ordinal", "chunk")


def burden_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unweighted burden score and variance, SKAT statistic and cMAC of every mask of balance."""
    rows = set_tests.burden_statistics(stored(star.calls(spark, sf_dir), "calls"), _linear(spark, sf_dir), _members(spark, sf_dir))
    z = F.round(F.col("score") / F.sqrt("variance"), 6) + F.lit(0.0)
    return rows.select("gene_name", "mask", "n_variants", z.alias("z"), F.round(F.col("skat_q") / F.col("variance"), 6).alias("q_ratio"), _r("cmac", 6))


def covariance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of oriented dosages summed over samples, for pairs of variants in one coding mask's gene."""
    calls, null = stored(star.calls(spark, sf_dir), "calls"), _linear(spark, sf_dir)
    orientation = association.oriented(association.variant_sums(calls, null))
    pairs = association.covariance_pairs(association.oriented_cells(calls, null, orientation), coding_masks(spark, sf_dir), null)
    sigma = null.models.select("trait", "sigma2")
    return pairs.join(sigma, "trait").select("gene_name", "v1", "v2", F.round(F.col("pair_sum") * F.col("sigma2"), 6).alias("product"))


def cauchy_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail areas taken from order discounts, combined per part and weighted by quantity."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = F.when(F.col("l_discount") == 0.01, 1e-20).otherwise(F.col("l_discount") + F.col("l_tax") + 0.001)
    return lines.groupBy("l_partkey").agg((F.round(F.log10(cauchy(p, F.col("l_quantity"))), 6) + F.lit(0.0)).alias("log_p"))


def _set_tests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    phred, names = _phred()
    long = set_tests.set_tests(stored(star.calls(spark, sf_dir), "calls"), _linear(spark, sf_dir), star.variants(spark, sf_dir), _members(spark, sf_dir), phred, names)
    return stored(long, "set_tests"), names


def burden_and_acat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burden and ACAT-V p-values of balance under all frequency and annotation weights, and their joint Cauchy combination."""
    long = _set_tests(spark, sf_dir)[0].filter("test <> 'S'")
    whole = long.groupBy("gene_name", "mask").agg(cauchy("p").alias("p")).select("gene_name", "mask", F.lit("all").alias("test"), F.lit("").alias("beta"), F.lit("").alias("annotation"), "p")
    return long.select("gene_name", "mask", "test", "beta", "annotation", "p").unionByName(whole).withColumn("p", F.round("p", 7) + F.lit(0.0))


def skat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SKAT p-values of balance's masks of two variants, away from the middle where another formula holds."""
    long = _set_tests(spark, sf_dir)[0].filter("test = 'S' and n_variants = 2 and (p < 0.29 or p > 0.41)")
    return long.select("gene_name", "mask", "beta", "annotation", _r("p", 4))


def gene_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mask tests of balance with their combined p-values, one row per mask."""
    long, names = _set_tests(spark, sf_dir)
    return set_tests.wide(long, names, "21")


def disruptive_missense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missense summaries joined by the disruptive masks' tests."""
    return set_tests.with_disruptive(_set_tests(spark, sf_dir)[0])


def binary_burdens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burden tests of building, by saddlepoint where nominally significant, with their summaries."""
    phred, names = _phred()
    burdens = set_tests.binary_burdens(stored(star.calls(spark, sf_dir), "calls"), _logistic(spark, sf_dir), star.variants(spark, sf_dir), _members(spark, sf_dir), phred, names)
    burdens = stored(burdens, "binary")
    each = burdens.select("trait", "gene_name", "mask", F.concat(F.lit("Burden("), "beta", F.lit(")"), F.when(F.col("annotation") != "", F.concat(F.lit("-"), "annotation")).otherwise("")).alias("name"), "p")
    return each.unionByName(set_tests.binary_summaries(burdens))


def kinship_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationship entries between listed samples whose diagonal is known."""
    listed = table(spark, sf_dir, "kinship_samples").filter("diagonal is not null").select(F.col("sample_index").alias("sample_idx"), F.col("diagonal").alias("value"))
    edges = table(spark, sf_dir, "kinship_edges").select(F.col("edge_rows").alias("i"), F.col("edge_cols").alias("j"), F.col("edge_values").alias("value")).filter("value = value and abs(value) < double('infinity')").distinct()
    return kinship.subset(listed, edges, listed)[1].select("i", "j", _r("value", 9))


def _mixed(spark: SparkSession, sf_dir: str) -> null_models.NullModel:
    design = star.design(spark, sf_dir).filter("trait = 'balance'")
    return kinship.fit_mixed_linear(design, *kinship.subset(*star.relatives(spark, sf_dir), design), 3)


def mixed_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance components and effects of balance with related customers."""
    return _mixed(spark, sf_dir).models.select("trait", "n", F.round(F.col("tau")[0], 0).alias("tau0"), F.round(F.col("tau")[1], 0).alias("tau1"), *(F.round(F.col("beta")[i], 4).alias(f"b{i}") for i in range(3)))


def mixed_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance component and effects of building with related customers."""
    design = star.design(spark, sf_dir).filter("trait = 'building'")
    model = kinship.fit_mixed_logistic(design, *kinship.subset(*star.relatives(spark, sf_dir), design), 3)
    return model.models.select("trait", "n", F.round(F.col("tau")[1], 4).alias("tau"), *(F.round(F.col("beta")[i], 4).alias(f"b{i}") for i in range(3)))


def single_variant_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-variant tests of balance under the related customers' precision matrix."""
    rows = association.single_variant(stored(star.calls(spark, sf_dir), "calls"), _mixed(spark, sf_dir), star.variants(spark, sf_dir))
    return rows.select("variant_idx", "pos", "pvalue", "est", "est_se")


def joint_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants tested for balance and number of orders together."""
    model = joint.fit_joint(star.joint_design(spark, sf_dir), ["balance", "n_orders"], 2)
    rows = joint.joint_single(stored(star.calls(spark, sf_dir), "calls"), model)
    return rows.select("variant_idx", _r("score1", 6), _r("score2", 4), _r("pvalue", 7), _r("pvalue_log10", 4))


def joint_set_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding masks tested for both traits together, with their combined p-values."""
    phred, names = _phred()
    model = joint.fit_joint(star.joint_design(spark, sf_dir), ["balance", "n_orders"], 2)
    long = stored(joint.joint_set_tests(stored(star.calls(spark, sf_dir), "calls"), model, star.variants(spark, sf_dir), coding_masks(spark, sf_dir), phred, names), "joint")
    return set_tests.omnibus(long.withColumn("trait", F.lit("joint"))).select("gene_name", "mask", "name", "p")


def streamed_allele_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele counts kept by the streaming job from call files as they arrive."""
    where = f"{shared_dir(spark)}/lodestrand/stream-{uuid.uuid4().hex}"
    star.calls(spark, sf_dir).write.parquet(f"{where}/calls")
    counts.start_counting(spark, f"{where}/calls", f"{where}/counts", f"{where}/mark").awaitTermination()
    return counts.totals(spark, f"{where}/counts", star.samples(spark, sf_dir).count()).select("variant_idx", "ref_ac", "called", "n_missing")


def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask sizes written as a sorted result CSV and read back."""
    where = f"{shared_dir(spark)}/lodestrand/results-{uuid.uuid4().hex}"
    files.write_results(mask_sizes(spark, sf_dir), where, ["gene_name", "mask"])
    return spark.read.schema("gene_name string, mask string, n_variants bigint").csv(where, header=True)


QUERIES = {
    f.__name__: f
    for f in (
        variant_stats, variant_stats_subset, mac_prescreen, minor_dosages, sample_keys, sample_alignment, alignment_counts, presence_flags, quality_summary,
        annotation_join, annotation_coverage, annotation_problems, annotation_weights, gene_span_join, promoter_overlap, coding_masks, ptv_masks_all_variants,
        noncoding_masks, mask_sizes, rare_masks, distinct_masks, rint_values, null_linear, null_logistic, residual_rint, single_variant, single_variant_p, single_two_chromosomes, binary_single, binary_single_nominal,
        burden_statistics, covariance_pairs, cauchy_combination, burden_and_acat, skat_pairs, gene_table, disruptive_missense, binary_burdens, kinship_subset, mixed_linear, mixed_logistic, single_variant_mixed,
        joint_single, joint_set_tests, streamed_allele_counts, result_sink,
    )
}

_LACKS = "([0, 1, 2, 2, 1, 2])[state + 1]"
_LACKS_CALLED = "([0, 0, 0, 2, 1, 1])[state + 1]"


def _frequency_sql(members: str, name: str = "freq") -> str:
    """Frequencies over the samples of a table, from every variant x sample cell."""
    return f"""
    {name}_counts AS (
      SELECT v.variant_idx, (SELECT count(*) FROM {members}) n, 2 * (SELECT count(*) FROM {members}) - coalesce(sum({_LACKS}), 0) ref_ac,
        2 * (SELECT count(*) FROM {members}) - coalesce(sum({_LACKS_CALLED}), 0) called, count(*) FILTER (state >= 3) n_missing,
        coalesce(sum(CASE WHEN state < 3 THEN state END), 0) alt_sum
      FROM variants v LEFT JOIN (SELECT * FROM calls WHERE sample_idx IN (SELECT sample_idx FROM {members})) k ON k.variant_idx = v.variant_idx GROUP BY v.variant_idx),
    {name} AS (
      SELECT *, least(ref_af, 1 - ref_af) maf, ref_af >= 0.5 counts_alt, least(alt_ac, ref_ac)::BIGINT initial_mac,
        CASE WHEN 1 - ref_af > 0.5 THEN 2 WHEN least(ref_af, 1 - ref_af) >= 0.01 OR missing_rate >= 0.01 THEN 1 ELSE 0 END extraction_group,
        CASE WHEN ref_af >= 0.5 THEN alt_sum ELSE 2 * (n - n_missing) - alt_sum END observed_mac
      FROM (SELECT *, ref_ac / called ref_af, (2 * n - called) / (2 * n) missing_rate, 2 * round_even(n * (1 - (2 * n - called) / (2 * n)), 0)::DOUBLE - ref_ac alt_ac FROM {name}_counts))"""


_FREQ = _frequency_sql("samples")
_CONDITIONS = {
    "plof": "exonic IN ('stopgain', 'stoploss') OR category IN ('splicing', 'exonic;splicing', 'ncRNA_splicing', 'ncRNA_exonic;splicing')",
    "missense": "exonic = 'nonsynonymous SNV'",
    "disruptive_missense": "exonic = 'nonsynonymous SNV' AND coalesce(metasvm, '') = 'D'",
    "synonymous": "exonic = 'synonymous SNV'",
    "ptv": "exonic IN ('stopgain', 'stoploss') OR category IN ('splicing', 'exonic;splicing')",
}
_CONDITIONS["plof_ds"] = f"({_CONDITIONS['plof']}) OR ({_CONDITIONS['disruptive_missense']})"
_CONDITIONS["ptv_ds"] = f"({_CONDITIONS['ptv']}) OR ({_CONDITIONS['disruptive_missense']})"
_SNV = "qc = 'PASS' AND length(ref) = 1 AND length(alt) = 1"
_IN_GENE = "JOIN genes g ON g.chrom = v.chrom AND v.pos BETWEEN g.start_pos AND g.end_pos"
_IN_PROMOTER = "EXISTS (SELECT 1 FROM promoters p WHERE p.chrom = v.chrom AND v.pos BETWEEN p.start_pos AND p.end_pos)"
_CODING = " UNION ALL ".join(f"SELECT gene_name, '{m}' mask, variant_idx FROM variants v {_IN_GENE} WHERE {_SNV} AND ({c})" for m, c in _CONDITIONS.items())
_TOKENS = {
    "upstream": ("category = 'upstream'", "string_split(info, ',')"),
    "downstream": ("category = 'downstream'", "string_split(info, ',')"),
    "UTR": ("category IN ('UTR3', 'UTR5', 'UTR5;UTR3')", "[split_part(info, '(', 1)]"),
    "promoter_CAGE": (f"cage <> '' AND {_IN_PROMOTER}", "[regexp_extract(info, '^[^(,;-]*')]"),
    "promoter_DHS": (f"dhs <> '' AND {_IN_PROMOTER}", "[regexp_extract(info, '^[^(,;-]*')]"),
    "enhancer_CAGE": ("genehancer <> '' AND cage <> ''", "[split_part(split_part(genehancer, '=', 4), ';', 1)]"),
    "enhancer_DHS": ("genehancer <> '' AND dhs <> ''", "[split_part(split_part(genehancer, '=', 4), ';', 1)]"),
    "ncRNA": ("category IN ('ncRNA_exonic', 'ncRNA_exonic;splicing', 'ncRNA_splicing')", "string_split(regexp_replace(split_part(info, ';', 1), '\\(.*\\)', ''), ',')[1:3]"),
}
_NONCODING = " UNION ALL ".join(f"SELECT DISTINCT t gene_name, '{m}' mask, variant_idx FROM (SELECT variant_idx, unnest({e}) t FROM variants v WHERE {_SNV} AND {c}) WHERE t IN (SELECT gene_name FROM genes)" for m, (c, e) in _TOKENS.items())
_MEMBERS = f"members AS ({_CODING} UNION ALL {_NONCODING})"

#: Least squares of balance by Cramer's rule, then every dosage of the cohort.
_DENSE = f"""
    cohort AS (SELECT * FROM design WHERE trait = 'balance'),
    s AS (SELECT count(*)::DOUBLE n, sum(x1) a, sum(x2) b, sum(x1 * x1) c, sum(x1 * x2) d, sum(x2 * x2) e, sum(y) p, sum(x1 * y) q, sum(x2 * y) r FROM cohort),
    inv AS (
      SELECT *, (c * e - d * d) / det i00, (b * d - a * e) / det i01, (a * d - b * c) / det i02, (n * e - b * b) / det i11, (a * b - n * d) / det i12, (n * c - a * a) / det i22
      FROM (SELECT *, n * (c * e - d * d) - a * (a * e - b * d) + b * (a * d - b * c) det FROM s)),
    fit AS (SELECT *, i00 * p + i01 * q + i02 * r b0, i01 * p + i11 * q + i12 * r b1, i02 * p + i12 * q + i22 * r b2 FROM inv),
    resid AS (SELECT sample_idx, x1, x2, y - b0 - b1 * x1 - b2 * x2 raw FROM cohort, fit),
    sigma AS (SELECT sum(raw * raw) / (count(*) - 3) sigma2 FROM resid),
    {_frequency_sql('cohort', 'cf')},
    dense AS (
      SELECT f.variant_idx, c.sample_idx, c.raw, c.x1, c.x2,
        CASE WHEN coalesce(state, 0) >= 3 THEN 2 * maf WHEN counts_alt THEN coalesce(state, 0) ELSE 2 - coalesce(state, 0) END g
      FROM cf f CROSS JOIN resid c LEFT JOIN calls k ON k.variant_idx = f.variant_idx AND k.sample_idx = c.sample_idx),
    scores AS (
      SELECT variant_idx, sum(g * raw) u, sum(g * g) gg, sum(g) g0, sum(g * x1) g1, sum(g * x2) g2, sum(g) cmac FROM dense GROUP BY variant_idx),
    tests AS (
      SELECT t.*, u / sigma2 score, (gg - (i00 * g0 * g0 + i11 * g1 * g1 + i22 * g2 * g2 + 2 * i01 * g0 * g1 + 2 * i02 * g0 * g2 + 2 * i12 * g1 * g2)) / sigma2 variance
      FROM scores t, inv, sigma)"""


def _with(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([star.SQL, *ctes])} {body}"


_RARE_BALANCE = "rare AS (SELECT m.* FROM members m JOIN cf ON cf.variant_idx = m.variant_idx WHERE maf > 0 AND maf < 0.01 QUALIFY count(*) OVER (PARTITION BY gene_name, mask) >= 2)"



def _erfc(x: str) -> str:
    """Complementary error function by its series of positive terms; x of 0 to about 8."""
    return f"(1 - exp(-pow({x}, 2)) * list_sum([exp((2 * i + 1) * ln(greatest({x}, 1e-300)) - lgamma(i + 1.5)) FOR i IN range(0, 160)]))"


def _cauchy_sql(t: str) -> str:
    return f"CASE WHEN {t} > 1e15 THEN 1 / ({t} * pi()) WHEN abs({t}) <= 1 THEN 0.5 - atan({t}) / pi() ELSE atan(1 / {t}) / pi() + ({t} <= 0)::INT END"


_TAN = "CASE WHEN p < 1e-16 THEN 1 / (p * pi()) ELSE tan((0.5 - p) * pi()) END"
_QUAD = "(i00 * {0}0 * {0}0 + i11 * {0}1 * {0}1 + i22 * {0}2 * {0}2 + 2 * i01 * {0}0 * {0}1 + 2 * i02 * {0}0 * {0}2 + 2 * i12 * {0}1 * {0}2)"
#: Weighted burdens per sample from all dosages, over all rare variants of a mask and over its very rare ones (prefix v).
_WEIGHTED = f"""
    marks AS (
      SELECT cf.variant_idx, maf, round_even(maf * 2 * n, 0) <= 10 few, c.j, c.beta, c.annotation, CASE c.j WHEN 0 THEN 1.0 WHEN 1 THEN 1 - pow(10, -coalesce(cadd, 0) / 10) WHEN 2 THEN 1 - pow(10, -local_diversity / 10)
        ELSE CASE WHEN local_diversity = 0 THEN 1.0 ELSE 1 - pow(10, log10(1 - pow(10, -local_diversity / 10))) END END rnk, CASE c.beta WHEN '1,25' THEN 25 * pow(1 - maf, 24) ELSE 1.0 END w
      FROM cf JOIN variants v ON v.variant_idx = cf.variant_idx, (SELECT j, beta, annotation FROM (VALUES (0, ''), (1, 'CADD'), (2, 'aPC.LocalDiversity'), (3, 'aPC.LocalDiversity(-)')) a(j, annotation), (VALUES ('1,25'), ('1,1')) b(beta)) c),
    burdens AS (
      SELECT gene_name, mask, beta, annotation, sample_idx, any_value(raw) raw, any_value(x1) x1, any_value(x2) x2, sum(rnk * w * g) b, sum(CASE WHEN few THEN rnk * w * g ELSE 0 END) v
      FROM rare JOIN marks m ON m.variant_idx = rare.variant_idx JOIN dense d ON d.variant_idx = rare.variant_idx GROUP BY ALL),
    burden_tests AS (
      SELECT gene_name, mask, beta, annotation, abs(bu) / sqrt(sigma2 * (bb - {_QUAD.format('b')})) bz, CASE WHEN vv > 0 THEN abs(vu) / sqrt(sigma2 * (vv - {_QUAD.format('v')})) END vz
      FROM (SELECT gene_name, mask, beta, annotation, sum(b * raw) bu, sum(b * b) bb, sum(b) b0, sum(b * x1) b1, sum(b * x2) b2, sum(v * raw) vu, sum(v * v) vv, sum(v) v0, sum(v * x1) v1, sum(v * x2) v2 FROM burdens GROUP BY ALL), inv, sigma),
    parts AS (
      SELECT gene_name, mask, beta, annotation, {_erfc('(abs(score) / sqrt(2 * variance))')} p, rnk * w * w * pi() * pi() * maf * (1 - maf) wa FROM rare JOIN marks m ON m.variant_idx = rare.variant_idx JOIN tests t ON t.variant_idx = rare.variant_idx WHERE NOT few
      UNION ALL
      SELECT gene_name, mask, beta, annotation, {_erfc('(vz / sqrt(2))')}, wa FROM burden_tests JOIN (
        SELECT gene_name, mask, beta, annotation, avg(rnk * w * w * pi() * pi() * maf * (1 - maf)) wa FROM rare JOIN marks m ON m.variant_idx = rare.variant_idx WHERE few GROUP BY ALL) USING (gene_name, mask, beta, annotation)),
    acat AS (SELECT gene_name, mask, beta, annotation, sum(wa * {_TAN}) / sum(wa) t FROM parts GROUP BY ALL),
    elementary AS (
      SELECT gene_name, mask, 'B' test, beta, annotation, {_erfc('(bz / sqrt(2))')} p FROM burden_tests UNION ALL SELECT gene_name, mask, 'A', beta, annotation, {_cauchy_sql('t')} FROM acat)"""


def _newton_sql(rounds: int) -> str:
    """Logistic regression of building by unrolled Newton steps, each solved by Cramer's rule."""
    ctes = ["units AS (SELECT sample_idx, y, x1, x2 FROM design WHERE trait = 'building')", "beta0 AS (SELECT 0.0::DOUBLE b0, 0.0::DOUBLE b1, 0.0::DOUBLE b2)"]
    for k in range(rounds):
        ctes.append(f"""sums{k} AS (
          SELECT any_value(b0) b0, any_value(b1) b1, any_value(b2) b2, sum(w) n, sum(w * x1) a, sum(w * x2) b, sum(w * x1 * x1) c, sum(w * x1 * x2) d, sum(w * x2 * x2) e, sum(y - m) p, sum((y - m) * x1) q, sum((y - m) * x2) r
          FROM (SELECT *, m * (1 - m) w FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) m FROM units, beta{k})))""")
        ctes.append(f"""beta{k + 1} AS (
          SELECT b0 + ((c * e - d * d) * p + (b * d - a * e) * q + (a * d - b * c) * r) / det b0, b1 + ((b * d - a * e) * p + (n * e - b * b) * q + (a * b - n * d) * r) / det b1, b2 + ((a * d - b * c) * p + (a * b - n * d) * q + (n * c - a * a) * r) / det b2
          FROM (SELECT *, n * (c * e - d * d) - a * (a * e - b * d) + b * (a * d - b * c) det FROM sums{k}))""")
    return ", ".join(ctes)


#: Cohort, frequencies and tests of building under the logistic model of _newton_sql(9).
_BINARY = f"""
    fitted AS (SELECT sample_idx, x1, x2, y - m raw, m * (1 - m) w FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) m FROM units, beta9)),
    ws AS (SELECT sum(w) n, sum(w * x1) a, sum(w * x2) b, sum(w * x1 * x1) c, sum(w * x1 * x2) d, sum(w * x2 * x2) e FROM fitted),
    winv AS (
      SELECT (c * e - d * d) / det i00, (b * d - a * e) / det i01, (a * d - b * c) / det i02, (n * e - b * b) / det i11, (a * b - n * d) / det i12, (n * c - a * a) / det i22
      FROM (SELECT *, n * (c * e - d * d) - a * (a * e - b * d) + b * (a * d - b * c) det FROM ws)),
    {_frequency_sql('units', 'bf')},
    wdense AS (
      SELECT f.variant_idx, c.raw, c.w, c.x1, c.x2, CASE WHEN coalesce(state, 0) >= 3 THEN 2 * maf WHEN counts_alt THEN coalesce(state, 0) ELSE 2 - coalesce(state, 0) END g
      FROM bf f CROSS JOIN fitted c LEFT JOIN calls k ON k.variant_idx = f.variant_idx AND k.sample_idx = c.sample_idx),
    wtests AS (
      SELECT variant_idx, u, gg - {_QUAD.format('g')} v
      FROM (SELECT variant_idx, sum(g * raw) u, sum(w * g * g) gg, sum(w * g) g0, sum(w * g * x1) g1, sum(w * g * x2) g2 FROM wdense GROUP BY variant_idx), winv)"""

#: Least squares of balance and number of orders on nation, and the joint test of both.
_JOINT = f"""
    jointly AS (SELECT sample_idx, balance y1, n_orders y2, nation x1 FROM traits JOIN covariates_of USING (sample_idx) WHERE balance IS NOT NULL AND n_orders IS NOT NULL),
    jfit AS (
      SELECT b / det i00, -a / det i01, n / det i11, (b * p1 - a * q1) / det c10, (n * q1 - a * p1) / det c11, (b * p2 - a * q2) / det c20, (n * q2 - a * p2) / det c21
      FROM (SELECT *, n * b - a * a det FROM (SELECT count(*)::DOUBLE n, sum(x1) a, sum(x1 * x1) b, sum(y1) p1, sum(x1 * y1) q1, sum(y2) p2, sum(x1 * y2) q2 FROM jointly))),
    jresid AS (SELECT sample_idx, x1, y1 - c10 - c11 * x1 r1, y2 - c20 - c21 * x1 r2 FROM jointly, jfit),
    jcov AS (SELECT s11, s12, s22, s11 * s22 - s12 * s12 det FROM (SELECT sum(r1 * r1) / (count(*) - 2) s11, sum(r1 * r2) / (count(*) - 2) s12, sum(r2 * r2) / (count(*) - 2) s22 FROM jresid)),
    {_frequency_sql("jointly", "jf")},
    jdense AS (
      SELECT f.variant_idx, f.initial_mac, f.maf, c.r1, c.r2, c.x1, CASE WHEN coalesce(state, 0) >= 3 THEN 2 * maf WHEN counts_alt THEN coalesce(state, 0) ELSE 2 - coalesce(state, 0) END g
      FROM jf f CROSS JOIN jresid c LEFT JOIN calls k ON k.variant_idx = f.variant_idx AND k.sample_idx = c.sample_idx),
    jtests AS (
      SELECT variant_idx, (s22 * a1 - s12 * a2) / det score1, (s11 * a2 - s12 * a1) / det score2, a1, a2, gg - (i00 * g0 * g0 + 2 * i01 * g0 * g1 + i11 * g1 * g1) v
      FROM (SELECT variant_idx, sum(g * r1) a1, sum(g * r2) a2, sum(g * g) gg, sum(g) g0, sum(g * x1) g1 FROM jdense WHERE initial_mac >= 20 AND maf > 0 AND maf < 1 GROUP BY variant_idx), jfit, jcov)"""

#: Masks of two variants: the eigenvalues of a 2 x 2 matrix, and the saddlepoint as root of a quadratic.
_PAIRS = f"""
    twos AS (SELECT gene_name, mask, min(variant_idx) v1, max(variant_idx) v2 FROM rare GROUP BY ALL HAVING count(*) = 2),
    crossed AS (SELECT v1, v2, sum(a.g * b.g) gg FROM (SELECT DISTINCT v1, v2 FROM twos) JOIN dense a ON a.variant_idx = v1 JOIN dense b ON b.variant_idx = v2 AND b.sample_idx = a.sample_idx GROUP BY ALL),
    covered AS (
      SELECT c.v1, c.v2, s.variance v11, t.variance v22, s.score u1, t.score u2,
        (c.gg - (i00 * s.g0 * t.g0 + i11 * s.g1 * t.g1 + i22 * s.g2 * t.g2 + i01 * (s.g0 * t.g1 + s.g1 * t.g0) + i02 * (s.g0 * t.g2 + s.g2 * t.g0) + i12 * (s.g1 * t.g2 + s.g2 * t.g1))) / sigma2 v12
      FROM crossed c JOIN tests s ON s.variant_idx = c.v1 JOIN tests t ON t.variant_idx = c.v2, inv, sigma),
    weighed AS (
      SELECT gene_name, mask, m.beta, m.annotation, m.rnk * m.w * m.w * v11 a, k.rnk * k.w * k.w * v22 d, sqrt(m.rnk * k.rnk) * m.w * k.w * v12 b, m.rnk * m.w * m.w * u1 * u1 + k.rnk * k.w * k.w * u2 * u2 q
      FROM twos JOIN covered c ON c.v1 = twos.v1 AND c.v2 = twos.v2 JOIN marks m ON m.variant_idx = twos.v1 JOIN marks k ON k.variant_idx = twos.v2 AND k.beta = m.beta AND k.annotation = m.annotation),
    spectra AS (SELECT *, (a + d + sqrt((a - d) ** 2 + 4 * b * b)) / 2 top, (a + d - sqrt((a - d) ** 2 + 4 * b * b)) / 2 low FROM weighed),
    scaled AS (SELECT gene_name, mask, beta, annotation, q / top x, CASE WHEN low < 1e-8 THEN 0 ELSE low / top END r FROM spectra WHERE top >= 1e-8),
    roots AS (SELECT *, 2 * (x - 1 - r) / (bb + sqrt(greatest(bb * bb - 16 * r * x * (x - 1 - r), 0))) t FROM (SELECT *, 2 * x * (1 + r) - 4 * r bb FROM scaled)),
    signed AS (SELECT *, sign(t) * sqrt(2 * (t * x + 0.5 * (ln(1 - 2 * t) + ln(1 - 2 * r * t)))) w, t * sqrt(2 / (1 - 2 * t) ** 2 + 2 * r * r / (1 - 2 * r * t) ** 2) k FROM roots WHERE abs(t) > 1e-4),
    skats AS (SELECT *, (w + ln(k / w) / w) / sqrt(2) z FROM signed),
    skat_p AS (SELECT gene_name, mask, beta, annotation, CASE WHEN z >= 0 THEN {_erfc('z')} / 2 ELSE 1 - {_erfc('abs(z)')} / 2 END p FROM skats)"""


ORACLE = {
    "binary_single_nominal": _with(
        f"""SELECT variant_idx, round(u / sqrt(v), 5) + 0.0 z, round(p, 6) + 0.0 pvalue, round(-log10(p), 4) + 0.0 pvalue_log10
            FROM (SELECT t.*, {_erfc('(abs(u) / sqrt(2 * v))')} p FROM wtests t JOIN bf ON bf.variant_idx = t.variant_idx WHERE initial_mac >= 20 AND maf > 0 AND maf < 1)""",
        _newton_sql(9), _BINARY,
    ),
    "single_two_chromosomes": _with(
        """SELECT variant_idx, chrom, pos, round(score / sqrt(variance), 6) + 0.0 z, row_number() OVER w - 1 ordinal, (row_number() OVER w - 1) // 500 chunk
           FROM (SELECT t.*, CASE WHEN v.variant_idx % 2 = 1 THEN '22' ELSE '21' END chrom, CASE WHEN v.variant_idx % 2 = 1 THEN 100000000 - v.pos ELSE v.pos END pos
                 FROM cf JOIN tests t ON t.variant_idx = cf.variant_idx JOIN variants v ON v.variant_idx = cf.variant_idx WHERE initial_mac >= 20 AND maf > 0 AND maf < 1)
           WINDOW w AS (PARTITION BY chrom ORDER BY pos, variant_idx)""",
        _DENSE,
    ),
    "joint_single": _with(
        """SELECT variant_idx, round(score1, 6) + 0.0 score1, round(score2, 4) + 0.0 score2, round(exp(-q / 2), 7) + 0.0 pvalue, round(q / 2 / ln(10), 4) + 0.0 pvalue_log10
           FROM (SELECT *, (score1 * a1 + score2 * a2) / v q FROM jtests)""",
        _JOINT,
    ),
    "skat_pairs": _with("SELECT gene_name, mask, beta, annotation, round(p, 4) + 0.0 p FROM skat_p WHERE p < 0.29 OR p > 0.41", _MEMBERS, _DENSE, _RARE_BALANCE, _WEIGHTED, _PAIRS),
    "null_logistic": _with("SELECT 'building' trait, (SELECT count(*) FROM units) n, round(b0, 6) b0, round(b1, 6) b1, round(b2, 6) b2, true at_optimum FROM beta9", _newton_sql(9)),
    "single_variant_p": _with(
        f"SELECT variant_idx, round(p, 8) + 0.0 pvalue, round(-log10(p), 4) + 0.0 pvalue_log10 FROM (SELECT cf.variant_idx, {_erfc('(abs(score) / sqrt(2 * variance))')} p FROM cf JOIN tests t ON t.variant_idx = cf.variant_idx WHERE initial_mac >= 20 AND maf > 0 AND maf < 1)", _DENSE
    ),
    "burden_and_acat": _with(
        f"""SELECT gene_name, mask, test, beta, annotation, CASE WHEN NOT isnan(p) THEN round(p, 7) + 0.0 END p FROM (
              SELECT * FROM elementary UNION ALL SELECT gene_name, mask, 'all', '', '', {_cauchy_sql('t')} FROM (SELECT gene_name, mask, avg({_TAN}) t FROM elementary GROUP BY ALL))""",
        _MEMBERS, _DENSE, _RARE_BALANCE, _WEIGHTED,
    ),
    "variant_stats": _with(
        "SELECT variant_idx, ref_ac::BIGINT ref_ac, called::BIGINT called, n_missing, round(ref_af, 9) ref_af, round(missing_rate, 9) missing_rate, initial_mac, round(maf, 9) maf, counts_alt, extraction_group, observed_mac::BIGINT observed_mac, round(observed_mac + n_missing * 2 * maf, 6) cmac FROM freq", _FREQ
    ),
    "variant_stats_subset": _with(
        """SELECT variant_idx, ref_ac::BIGINT ref_ac, called::BIGINT called, n_missing, initial_mac, round(maf, 9) reference_mean,
             round(round_even(2 * maf * (1 - missing_rate) * n, 0)::DOUBLE / (2 * n), 9) reference_minor, round(observed_mac / (2 * (n - n_missing)), 9) count_mean, round(observed_mac / (2 * n), 9) count_minor FROM part_freq""",
        "building AS (SELECT sample_idx FROM samples WHERE segment = 'BUILDING')", _frequency_sql("building", "part_freq"),
    ),
    "mac_prescreen": _with("SELECT variant_idx, least(ref_ac, called - ref_ac + 1)::BIGINT bound FROM freq WHERE least(ref_ac, called - ref_ac + 1) >= 20", _FREQ),
    "minor_dosages": _with("SELECT k.variant_idx, count(*) n_stored, round(sum(CASE WHEN state >= 3 THEN 2 * maf WHEN counts_alt THEN state ELSE 2 - state END), 6) dosage_sum FROM calls k JOIN freq f ON f.variant_idx = k.variant_idx GROUP BY k.variant_idx", _FREQ),
    "sample_keys": _with("SELECT sample_idx, sample_key, fid, iid FROM samples"),
    "sample_alignment": _with("SELECT sample_idx, balance y, nation, n_orders FROM traits JOIN covariates_of USING (sample_idx) WHERE balance IS NOT NULL AND n_orders IS NOT NULL"),
    "alignment_counts": _with(
        """SELECT (SELECT count(*) FROM axis JOIN traits USING (sample_idx) JOIN covariates_of USING (sample_idx) WHERE balance IS NOT NULL AND n_orders IS NOT NULL) n_matched,
             (SELECT count(*) FROM axis) - (SELECT count(*) FROM axis JOIN traits USING (sample_idx) JOIN covariates_of USING (sample_idx) WHERE balance IS NOT NULL AND n_orders IS NOT NULL) n_excluded, (SELECT count(*) FROM traits WHERE sample_idx NOT IN (SELECT sample_idx FROM axis)) n_absent""",
        "axis AS (SELECT sample_idx FROM samples WHERE segment <> 'MACHINERY')",
    ),
    "presence_flags": _with("SELECT sample_idx, n_orders, n_orders IS NOT NULL present FROM covariates_of"),
    "quality_summary": _with(
        """SELECT trait, count(*) n_rows, count(*) - count(y) n_missing, min(y) least, max(y) greatest, CASE WHEN bool_and(y IN (0, 1)) THEN 'binomial' ELSE 'gaussian' END family,
             CASE WHEN bool_and(y IN (0, 1)) THEN count(*) FILTER (y = 1) END n_cases, CASE WHEN bool_and(y IN (0, 1)) THEN count(*) FILTER (y = 0) END n_controls
           FROM (SELECT 'balance' trait, balance y FROM traits UNION ALL SELECT 'building', building FROM traits) GROUP BY trait"""
    ),
    "annotation_join": _with("SELECT variant_idx, a.pos IS NOT NULL annotation_available, CASE WHEN score NOT IN ('', '.', 'NA', 'NaN') THEN score::DOUBLE END score FROM variants v LEFT JOIN raw_annotations a ON a.pos = v.pos AND ((a1 = ref AND a2 = alt) OR (a1 = alt AND a2 = ref))"),
    "annotation_coverage": _with(
        """SELECT count(*) FILTER (snv) n_snv, count(*) FILTER (snv AND here) n_snv_annotated, count(*) FILTER (NOT snv) n_other, count(*) FILTER (NOT snv AND here) n_other_annotated
           FROM (SELECT length(ref) = 1 AND length(alt) = 1 snv, a.pos IS NOT NULL here FROM variants v LEFT JOIN raw_annotations a ON a.pos = v.pos AND least(a1, a2) = least(ref, alt) AND greatest(a1, a2) = greatest(ref, alt))"""
    ),
    "annotation_problems": _with(
        """SELECT 'repeated' problem, pos, least(a1, a2) low, greatest(a1, a2) high FROM raw_annotations WHERE pos % 5 = 1
           UNION ALL SELECT 'missing', pos, least(ref, alt), greatest(ref, alt) FROM variants WHERE length(ref) = 1 AND length(alt) = 1 AND pos NOT IN (SELECT pos FROM raw_annotations)"""
    ),
    "annotation_weights": _with(
        """SELECT variant_idx, kind, (i * 4 + j)::INT AS at, round(CASE kind WHEN 'B' THEN rank * w WHEN 'S' THEN sqrt(rank) * w ELSE rank * w * w * pi() * pi() * maf * (1 - maf) END, 9) weight
           FROM ranks, (SELECT unnest(['B', 'S', 'A']) kind), (SELECT unnest([0, 1]) i), LATERAL (SELECT CASE i WHEN 0 THEN 25 * pow(1 - maf, 24) ELSE 1.0 END w)""",
        _FREQ,
        """ranks AS (
             SELECT variant_idx, maf, j, CASE j WHEN 0 THEN 1.0 WHEN 1 THEN 1 - pow(10, -coalesce(cadd, 0) / 10) WHEN 2 THEN 1 - pow(10, -local_diversity / 10)
               ELSE CASE WHEN local_diversity = 0 THEN 1.0 ELSE 1 - pow(10, log10(1 - pow(10, -local_diversity / 10))) END END rank
             FROM variants JOIN (SELECT variant_idx, maf FROM freq WHERE maf > 0 AND maf < 0.01) USING (variant_idx), (SELECT unnest([0, 1, 2, 3]) j))""",
    ),
    "gene_span_join": _with("SELECT gene_name, variant_idx FROM variants v JOIN genes g ON g.chrom = v.chrom AND v.pos BETWEEN g.start_pos - 35 AND g.end_pos + 35"),
    "promoter_overlap": _with(f"SELECT variant_idx FROM variants v WHERE {_IN_PROMOTER}"),
    "coding_masks": _with(_CODING),
    "ptv_masks_all_variants": _with(
        f"""SELECT gene_name, 'ptv' mask, variant_idx FROM variants v {_IN_GENE} WHERE qc = 'PASS' AND ({_CONDITIONS['ptv']} OR exonic LIKE 'frameshift%')
            UNION ALL SELECT gene_name, 'ptv_ds', variant_idx FROM variants v {_IN_GENE} WHERE qc = 'PASS' AND ({_CONDITIONS['ptv_ds']} OR exonic LIKE 'frameshift%')"""
    ),
    "noncoding_masks": _with(_NONCODING),
    "mask_sizes": _with("SELECT gene_name, mask, count(*) n_variants FROM members GROUP BY ALL", _MEMBERS),
    "rare_masks": _with(
        "SELECT gene_name, mask, m.variant_idx FROM members m JOIN freq ON freq.variant_idx = m.variant_idx WHERE maf > 0 AND maf < 0.01 QUALIFY count(*) OVER (PARTITION BY gene_name, mask) BETWEEN 2 AND 6", _MEMBERS, _FREQ
    ),
    "distinct_masks": _with(
        """SELECT gene_name, mask, first_value(gene_name || '/' || mask) OVER (PARTITION BY vs ORDER BY gene_name, mask) set_id, len(vs) n_variants
           FROM (SELECT gene_name, mask, list(variant_idx ORDER BY variant_idx) vs FROM members GROUP BY ALL)""",
        _MEMBERS,
    ),
    "rint_values": _with(
        f"SELECT trait, sample_idx, rnk AS rank, n, round({normal_quantile_sql('u')}, 9) + 0.0 AS rint FROM (SELECT *, (rnk - 0.375) / (n + 0.25) u FROM ranked)",
        """ranked AS (
             SELECT trait, sample_idx, rank() OVER (PARTITION BY trait ORDER BY y) + (count(*) OVER (PARTITION BY trait, y) - 1) / 2 rnk, count(*) OVER (PARTITION BY trait) n
             FROM (SELECT sample_idx, 'balance' trait, balance y FROM traits UNION ALL SELECT sample_idx, 'building', building FROM traits) WHERE y IS NOT NULL)""",
    ),
    "null_linear": _with("SELECT 'balance' trait, n::BIGINT n, round(b0, 6) b0, round(b1, 6) b1, round(b2, 6) b2, round(sigma2, 3) sigma2 FROM fit, sigma", _DENSE),
    "residual_rint": _with(
        f"SELECT sample_idx, round(sd * ({normal_quantile_sql('u')}), 6) + 0.0 y FROM (SELECT *, (rnk - 0.375) / (n + 0.25) u FROM ranked), (SELECT stddev_samp(y) sd FROM cohort)",
        _DENSE,
        "ranked AS (SELECT sample_idx, rank() OVER (ORDER BY raw) rnk, count(*) OVER () n FROM resid)",
    ),
    "single_variant": _with(
        """SELECT v.variant_idx, v.pos, v.ref, v.alt, round(1 - ref_af, 9) alt_af, round(maf, 9) maf, n, round(score / sqrt(variance), 6) + 0.0 z, round(score / variance, 4) + 0.0 est, round(1 / sqrt(variance), 4) est_se,
             row_number() OVER w - 1 ordinal, (row_number() OVER w - 1) // 500 chunk, (maf < 0.01 AND missing_rate < 0.01)::INT is_rare, extraction_group
           FROM cf JOIN tests t ON t.variant_idx = cf.variant_idx JOIN variants v ON v.variant_idx = cf.variant_idx WHERE initial_mac >= 20 AND maf > 0 AND maf < 1 WINDOW w AS (ORDER BY v.pos, v.variant_idx)""",
        _DENSE,
    ),
    "burden_statistics": _with(
        """SELECT b.gene_name, b.mask, n_variants, round(score / sqrt(variance), 6) + 0.0 z, round(skat_q / variance, 6) q_ratio, round(cmac, 6) cmac FROM (
             SELECT gene_name, mask, sum(g * raw) / any_value(sigma2) score, sum(g) cmac,
               (sum(g * g) - any_value(i00) * sum(g) ** 2 - any_value(i11) * sum(g * x1) ** 2 - any_value(i22) * sum(g * x2) ** 2
                - 2 * any_value(i01) * sum(g) * sum(g * x1) - 2 * any_value(i02) * sum(g) * sum(g * x2) - 2 * any_value(i12) * sum(g * x1) * sum(g * x2)) / any_value(sigma2) variance
             FROM (SELECT gene_name, mask, sample_idx, sum(g) g, any_value(raw) raw, any_value(x1) x1, any_value(x2) x2 FROM rare JOIN dense USING (variant_idx) GROUP BY ALL), inv, sigma GROUP BY gene_name, mask) b
           JOIN (SELECT gene_name, mask, count(*) n_variants, sum(score * score) skat_q FROM rare JOIN tests USING (variant_idx) GROUP BY ALL) q ON q.gene_name = b.gene_name AND q.mask = b.mask""",
        _MEMBERS, _DENSE, _RARE_BALANCE,
    ),
    "covariance_pairs": _with(
        """SELECT a.gene_name, a.variant_idx v1, b.variant_idx v2, round(sum(a.e * b.e), 6) product FROM placed a JOIN placed b ON a.gene_name = b.gene_name AND a.sample_idx = b.sample_idx AND a.variant_idx <= b.variant_idx GROUP BY ALL""",
        f"coding AS (SELECT DISTINCT gene_name, variant_idx FROM ({_CODING}))", _DENSE,
        """placed AS (SELECT gene_name, d.variant_idx, d.sample_idx, g - CASE WHEN counts_alt THEN 0 ELSE 2 END e FROM dense d JOIN cf ON cf.variant_idx = d.variant_idx JOIN coding c ON c.variant_idx = d.variant_idx
           WHERE g <> CASE WHEN counts_alt THEN 0 ELSE 2 END)""",
    ),
    "kinship_subset": """
        SELECT i, j, round(value, 9) + 0.0 AS value FROM (SELECT DISTINCT edge_rows i, edge_cols j, edge_values + 0.0 AS value FROM kinship_edges WHERE isfinite(edge_values))
        WHERE i IN (SELECT sample_index FROM kinship_samples WHERE diagonal IS NOT NULL) AND j IN (SELECT sample_index FROM kinship_samples WHERE diagonal IS NOT NULL)""",
    "streamed_allele_counts": _with("SELECT DISTINCT f.variant_idx, ref_ac::BIGINT ref_ac, called::BIGINT called, f.n_missing FROM freq f JOIN calls k ON k.variant_idx = f.variant_idx", _FREQ),
    "result_sink": _with("SELECT gene_name, mask, count(*) n_variants FROM members GROUP BY ALL", _MEMBERS),
    "cauchy_combination": """
        SELECT l_partkey, round(log10(CASE WHEN t > 1e15 THEN 1 / (t * pi()) WHEN abs(t) <= 1 THEN 0.5 - atan(t) / pi() ELSE atan(1 / t) / pi() + (t <= 0)::INT END), 6) + 0.0 log_p
        FROM (SELECT l_partkey, sum(l_quantity * CASE WHEN p < 1e-16 THEN 1 / (p * pi()) ELSE tan((0.5 - p) * pi()) END) / sum(l_quantity) t
              FROM (SELECT l_partkey, l_quantity, CASE WHEN l_discount = 0.01 THEN 1e-20 ELSE l_discount + l_tax + 0.001 END p FROM lineitem) GROUP BY l_partkey)""",
}
