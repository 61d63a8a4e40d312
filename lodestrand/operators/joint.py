"""Joint tests of several continuous traits measured on the same samples.

The residual covariance S of the traits is estimated after least squares. Scores are those of the
residuals times S^-1, and their covariance is S^-1 times the one-trait covariance with unit weights,
so joint tests need one genotype covariance only, however many traits there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numerics
from ..functions.tails import log_chi2_sf
from ..session import broadcast_if_small, stored
from .annotations import association_weights
from .association import covariance_pairs, oriented_cells, scores
from .genotypes import cumulative_mac
from .null_models import NullModel, fit_linear
from .set_tests import VERY_RARE_MAC, gene_covariance, rare_members

_LONG = "gene_name string, mask string, n_variants int, cmac double, test string, beta string, annotation string, p double"


@dataclass
class JointModel:
    """``null`` has one unit-weight trait per joint trait; ``covariance`` is S in the order of ``traits``."""

    null: NullModel
    traits: list[str]
    covariance: np.ndarray


def fit_joint(design: DataFrame, traits: Sequence[str], p: int) -> JointModel:
    """Fit the traits of ``design`` (trait, sample_idx, y, x*) on the samples that have them all."""
    traits = list(traits)
    complete = design.filter(F.col("trait").isin(traits)).groupBy("sample_idx").agg(F.count_distinct("trait").alias("k")).filter(F.col("k") == len(traits))
    rows = design.filter(F.col("trait").isin(traits)).join(complete.select("sample_idx"), "sample_idx", "left_semi")
    linear = fit_linear(rows, p)
    raw = linear.samples.join(broadcast_if_small(linear.models.select("trait", "sigma2")), "trait").withColumn("raw", F.col("resid") * F.col("sigma2"))
    x = [f"x{i}" for i in range(p)]
    wide = stored(raw.groupBy("sample_idx", *x).pivot("trait", traits).agg(F.first("raw")), "joint")
    pairs = [(a, b) for a in range(len(traits)) for b in range(a, len(traits))]
    sums = wide.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"`{traits[a]}`") * F.col(f"`{traits[b]}`")).alias(f"s{a}_{b}") for a, b in pairs)).first()  # one row
    s = np.zeros((len(traits), len(traits)))
    for a, b in pairs:
        s[a, b] = s[b, a] = sums[f"s{a}_{b}"] / (sums["n"] - p)
    inverse = np.linalg.inv(s)
    mixed = [F.struct(F.lit(t).alias("trait"), sum((F.col(f"`{u}`") * float(inverse[i, k]) for k, u in enumerate(traits)), F.lit(0.0)).alias("resid")) for i, t in enumerate(traits)]
    samples = wide.select("sample_idx", *x, F.explode(F.array(*mixed)).alias("m")).select("m.trait", "sample_idx", "m.resid", F.lit(1.0).alias("w"), F.lit(1.0).alias("w1"), F.lit(None).cast("double").alias("mu"), *x, *(F.col(c).alias(f"w{c}") for c in x))
    samples = stored(samples, "joint_samples")
    sums = samples.groupBy("trait").agg(F.sum("resid").alias("r0"), F.sum("w").alias("w0"), F.array(*(F.sum(f"wx{i}") for i in range(p))).alias("xw0"))
    models = linear.models.select("trait", "family", "n", "beta", F.transform("cov", lambda c: c / F.col("sigma2")).alias("cov"), F.lit(1.0).alias("sigma2")).join(sums, "trait")
    return JointModel(NullModel(samples, stored(models, "joint_models"), p), traits, s)


def _statistic(u: list[Column], variance: Column, s: np.ndarray) -> Column:
    """u' (S^-1 variance)^-1 u."""
    total = sum((u[a] * u[b] * float(s[a, b]) for a in range(len(u)) for b in range(len(u))), F.lit(0.0))
    return total / F.when(variance > 0, variance)


def joint_single(calls: DataFrame, joint: JointModel, mac_cutoff: float = 20, imputation: str = "mean") -> DataFrame:
    """variant_idx, score1 .. scoreT, pvalue, pvalue_log10 of every variant with initial_mac >= mac_cutoff; p is 1 without variance."""
    scored = scores(calls, joint.null, imputation).filter(F.col("initial_mac") >= mac_cutoff).filter("maf > 0 and maf < 1")
    each = [F.sum(F.when(F.col("trait") == t, F.col("score"))).alias(f"score{i + 1}") for i, t in enumerate(joint.traits)]
    rows = scored.groupBy("variant_idx").agg(*each, F.max("variance").alias("variance"))
    names = [f"score{i + 1}" for i in range(len(joint.traits))]
    rows = rows.withColumn("_half", F.greatest(_statistic([F.col(c) for c in names], F.col("variance"), joint.covariance), F.lit(0.0)) / 2)
    rows = rows.withColumn("log_p", F.when(F.col("variance") > 0, -log_chi2_sf(F.col("_half"), len(names))).otherwise(0.0))
    return rows.select("variant_idx", *names, F.exp(-F.col("log_p")).alias("pvalue"), (F.col("log_p") / math.log(10)).alias("pvalue_log10"))


def joint_set_tests(calls: DataFrame, joint: JointModel, variants: DataFrame, members: DataFrame, phred: Column, names: Sequence[str], cutoff: float = 0.01, at_least: int = 2, imputation: str = "mean") -> DataFrame:
    """Elementary joint p-values of every mask in the long form of single-trait tests, without the trait column.

    SKAT sums over traits and variants; Burden and ACAT-V use chi-squares with one degree of freedom per trait.
    """
    null, s, k = joint.null, joint.covariance, len(joint.traits)
    scored = scores(calls, null, imputation)
    first = scored.filter(F.col("trait") == joint.traits[0])
    rare = stored(rare_members(members, first, cutoff, at_least), "members")
    u = scored.groupBy("variant_idx").agg(F.array(*(F.sum(F.when(F.col("trait") == t, F.col("score"))) for t in joint.traits)).alias("u"))
    per_variant = rare.groupBy("gene_name", "variant_idx").agg(F.collect_set("mask").alias("masks"))
    weights = association_weights(F.col("test_maf"), F.col("phred"))
    rows = (
        per_variant.join(first, "variant_idx")
        .join(u, "variant_idx")
        .join(variants.select("variant_idx", phred.alias("phred")), "variant_idx")
        .select("gene_name", "variant_idx", "masks", "u", "cross", "base", "e_w1", "w0", "cov", "extraction_group", F.rint(F.col("test_maf") * 2 * F.col("n")).alias("mac"), cumulative_mac("test_maf", imputation).alias("cmac"), *(w.alias(f"w{c}") for c, w in weights.items()))
    )
    used = per_variant.select("gene_name", "variant_idx")
    cells = oriented_cells(calls, null, first.join(used.select("variant_idx").distinct(), "variant_idx", "left_semi"))
    pairs = covariance_pairs(cells, used, null)
    labels = [(b, n) for b in ("1,25", "1,1") for n in ("", *names)]
    spectrum = np.linalg.eigvalsh(np.linalg.inv(s))
    p_design = null.p

    def joint_p(score: np.ndarray, variance: float) -> float:
        return numerics.chi2_sf(float(score @ s @ score) / variance, k) if variance > 0 else math.nan

    def test(key: tuple, gene: pd.DataFrame, products: pd.DataFrame) -> pd.DataFrame:
        columns = ["gene_name", "mask", "n_variants", "cmac", "test", "beta", "annotation", "p"]
        if gene.empty:
            return pd.DataFrame(columns=columns)
        gene = gene.sort_values(["extraction_group", "variant_idx"])
        whole, out = gene_covariance(gene, products, p_design), []
        scores_of, mac, cmac = np.stack(gene["u"].to_list()), gene["mac"].to_numpy(), gene["cmac"].to_numpy()
        all_weights = {c: np.stack(gene[f"w{c}"].to_list()) for c in "SBA"}
        for mask in sorted({m for ms in gene["masks"] for m in ms}):
            at = np.array([mask in ms for ms in gene["masks"]])
            v, us, few = whole[np.ix_(at, at)], scores_of[at], mac[at] <= VERY_RARE_MAC
            for i, (beta, name) in enumerate(labels):
                ws, wb, wa = (all_weights[c][at, i] for c in "SBA")
                try:
                    skat = numerics.quadratic_form_sf(float(((us * ws[:, None]) ** 2).sum()), np.outer(spectrum, np.linalg.eigvalsh(v * np.outer(ws, ws))).ravel())
                except ArithmeticError:
                    skat = math.nan
                parts = [joint_p(us[j], v[j, j]) for j in np.flatnonzero(~few)]
                shares = list(wa[~few])
                if few.any():
                    parts.append(joint_p(us[few].T @ wb[few], float(wb[few] @ v[np.ix_(few, few)] @ wb[few])))
                    shares.append(wa[few].mean())
                try:
                    acat = numerics.cauchy(parts, shares)
                except ValueError:
                    acat = math.nan
                burden = joint_p(us.T @ wb, float(wb @ v @ wb))
                out += [(key[0], mask, int(at.sum()), float(cmac[at].sum()), c, beta, name, None if math.isnan(p) else float(p)) for c, p in (("S", skat), ("B", burden), ("A", acat))]
        return pd.DataFrame(out, columns=columns)

    return rows.groupBy("gene_name").cogroup(pairs.groupBy("gene_name")).applyInPandas(test, _LONG)
