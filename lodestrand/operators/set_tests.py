"""Gene-mask tests: Burden, SKAT and ACAT-V under two frequency weights and any annotations.

Spark selects rare members, builds weights and sums genotype products per gene; one grouped task
per trait and gene then holds only the gene's covariance matrix (variants x variants) and takes
eigenvalues and tails for all its masks. Results are long: one row per elementary p-value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numerics
from ..functions.combine import cauchy, cauchy_spa
from ..functions.tails import erfc
from ..session import stored
from .annotations import association_weights
from .association import covariance_pairs, oriented_cells, quadratic, scores, weighted_cells
from .genotypes import cumulative_mac
from .null_models import NullModel
from .saddlepoint import saddlepoint_p

BETAS = ("1,25", "1,1")
TESTS = {"S": "SKAT", "B": "Burden", "A": "ACAT-V"}
VERY_RARE_MAC = 10
#: Rare variants of the largest gene whose covariance is built; the matrix of doubles then takes half a gigabyte.
MAX_GENE = 8_000

_LONG = "trait string, gene_name string, mask string, n_variants int, cmac double, test string, beta string, annotation string, p double"


def rare_members(members: DataFrame, scored: DataFrame, cutoff: float = 0.01, at_least: int = 2, maximum: int | None = None) -> DataFrame:
    """trait, gene_name, mask, variant_idx of masks with enough rare variants in the trait (0 < maf < cutoff, both frequencies).

    Masks with more than ``maximum`` rare variants are skipped where it is given.
    """
    keep = scored.filter(f"maf > 0 and maf < {cutoff!r} and test_maf > 0 and test_maf < {cutoff!r}").select("trait", "variant_idx")
    rows = members.join(keep, "variant_idx")
    sizes = rows.groupBy("trait", "gene_name", "mask").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") >= at_least)
    if maximum is not None:
        sizes = sizes.filter(F.col("_m") <= maximum)
    return rows.join(sizes.drop("_m"), ["trait", "gene_name", "mask"], "left_semi").select("trait", "gene_name", "mask", "variant_idx")


def _chi1(score: np.ndarray, variance: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(variance > 0, numerics.chi2_1_sf(score**2 / np.where(variance > 0, variance, 1)), np.nan)


def mask_p_values(u: np.ndarray, v: np.ndarray, mac: np.ndarray, weights: dict[str, np.ndarray], long_threshold: int = 5000, long_rank: int = 512, long_method: str = "residual", seed: int = 1729, dof: int | None = None) -> dict[str, np.ndarray]:
    """p-values S, B and A of one mask, one per column of the weights (variants x columns).

    Scores ``u`` and covariance ``v`` belong to rare minor-oriented dosages. Up to ``long_threshold``
    variants SKAT takes the whole spectrum, beyond it the leading ``long_rank`` eigenvalues with a
    residual term, or matched moments (``long_method`` liu). With ``dof`` ACAT-V's common variants
    are calibrated by Student's t. NaN marks a test without variance.
    """
    columns = weights["B"].shape[1]
    burden = _chi1(weights["B"].T @ u, np.einsum("jc,jk,kc->c", weights["B"], v, weights["B"]))
    ws = weights["S"].T
    q = (ws**2) @ (u**2)
    if len(u) <= long_threshold:
        skat = numerics.quadratic_forms_sf(q, np.linalg.eigvalsh(v * ws[:, :, None] * ws[:, None, :]))
    else:
        skat = np.full(columns, np.nan)
        for c in range(columns):
            matrix = v * np.outer(ws[c], ws[c])
            try:
                skat[c] = numerics.liu_sf(q[c], numerics.power_sums(matrix, long_rank, seed=seed)) if long_method == "liu" else numerics.long_mask_sf(q[c], matrix, long_rank, seed)
            except ArithmeticError:
                pass
    common = mac > VERY_RARE_MAC
    each = _chi1(u[common], np.diag(v)[common])
    if dof is not None:
        explained = u[common] ** 2 / np.diag(v)[common]
        each = np.array([numerics.student_two_sided(e / (dof - e) * (dof - 1), dof - 1) for e in explained])
    acat = np.full(columns, np.nan)
    for c in range(columns):
        p, w = list(each), list(weights["A"][common, c])
        if not common.all():
            wb, part = weights["B"][~common, c], v[np.ix_(~common, ~common)]
            p.append(float(_chi1(wb @ u[~common], wb @ part @ wb)))
            w.append(weights["A"][~common, c].mean())
        try:
            acat[c] = numerics.cauchy(p, w)
        except ValueError:
            pass
    return {"S": skat, "B": burden, "A": acat}


def _labels(names: Sequence[str]) -> list[tuple[str, str]]:
    return [(beta, name) for beta in BETAS for name in ("", *names)]


def gene_covariance(gene: pd.DataFrame, products: pd.DataFrame, p: int) -> np.ndarray:
    """Score covariance of a gene's variants in row order from base, e_w1, cross, cov and the stored pair products."""
    place = pd.Series(np.arange(len(gene)), index=gene["variant_idx"].to_numpy())
    v = np.zeros((len(gene), len(gene)))
    kept = products["v1"].isin(place.index) & products["v2"].isin(place.index)
    i, j = place[products.loc[kept, "v1"]].to_numpy(), place[products.loc[kept, "v2"]].to_numpy()
    v[i, j] = v[j, i] = products.loc[kept, "pair_sum"]
    base, e, c = gene["base"].to_numpy(), gene["e_w1"].to_numpy(), np.stack(gene["cross"].to_list())
    cov = np.array(gene["cov"].iloc[0]).reshape(p, p)
    return v + np.outer(base, base) * gene["w0"].iloc[0] + np.outer(base, e) + np.outer(e, base) - c @ cov @ c.T


def set_tests(calls: DataFrame, null: NullModel, variants: DataFrame, members: DataFrame, phred: Column, names: Sequence[str], cutoff: float = 0.01, at_least: int = 2, maximum: int | None = None, imputation: str = "mean", long_threshold: int = 5000, long_rank: int = 512, long_method: str = "residual", student_acat: bool = False) -> DataFrame:
    """Elementary p-values of every trait and mask: trait, gene_name, mask, n_variants, cmac, test (S, B, A), beta, annotation, p.

    ``members`` has gene_name, mask, variant_idx; ``phred`` is an array expression over ``variants``
    whose entries ``names`` name. Masks with fewer than ``at_least`` rare variants give no rows. A gene
    whose masks hold more than MAX_GENE rare variants together is an error that names it: give
    ``maximum`` to leave such masks out; ``burden_statistics`` and ``binary_burdens`` have no such limit.
    ``student_acat`` calibrates ACAT-V's single variants by Student's t (least-squares traits only).
    """
    p_design = null.p
    scored = scores(calls, null, imputation)
    rare = stored(rare_members(members, scored, cutoff, at_least, maximum), "members")
    largest = rare.groupBy("trait", "gene_name").agg(F.count_distinct("variant_idx").alias("n")).orderBy(F.desc("n")).first()
    if largest is not None and largest["n"] > MAX_GENE:
        raise ValueError(f"gene {largest['gene_name']} has {largest['n']} rare variants, above {MAX_GENE}")
    per_variant = rare.groupBy("trait", "gene_name", "variant_idx").agg(F.collect_set("mask").alias("masks"))
    weights = association_weights(F.col("test_maf"), F.col("phred"))
    rows = (
        per_variant.join(scored, ["trait", "variant_idx"])
        .join(variants.select("variant_idx", phred.alias("phred")), "variant_idx")
        .select("trait", "gene_name", "variant_idx", "masks", "score", "cross", "base", "e_w1", "w0", "cov", "n", "extraction_group", F.rint(F.col("test_maf") * 2 * F.col("n")).alias("mac"), cumulative_mac("test_maf", imputation).alias("cmac"), *(w.alias(f"w{k}") for k, w in weights.items()))
    )
    used = per_variant.select("trait", "gene_name", "variant_idx")
    cells = stored(oriented_cells(calls, null, scored.join(used.select("trait", "variant_idx").distinct(), ["trait", "variant_idx"], "left_semi")), "cells")
    pairs = covariance_pairs(cells, used.select("gene_name", "variant_idx"), null)
    pairs = pairs.select(*(F.col(c).alias(c) for c in pairs.columns))  # names of its own beside those of rows
    labels = _labels(names)

    def test(key: tuple, gene: pd.DataFrame, products: pd.DataFrame) -> pd.DataFrame:
        if gene.empty:
            return pd.DataFrame(columns=["trait", "gene_name", "mask", "n_variants", "cmac", "test", "beta", "annotation", "p"])
        gene = gene.sort_values(["extraction_group", "variant_idx"])
        v = gene_covariance(gene, products, p_design)
        u, mac, cmac = gene["score"].to_numpy(), gene["mac"].to_numpy(), gene["cmac"].to_numpy()
        all_weights = {k: np.stack(gene[f"w{k}"].to_list()) for k in TESTS}
        dof = int(gene["n"].iloc[0]) - p_design if student_acat else None
        out = []
        for mask in sorted({m for ms in gene["masks"] for m in ms}):
            at = np.array([mask in ms for ms in gene["masks"]])
            tests = mask_p_values(u[at], v[np.ix_(at, at)], mac[at], {k: w[at] for k, w in all_weights.items()}, long_threshold, long_rank, long_method, dof=dof)
            for k, ps in tests.items():
                out += [(*key, mask, int(at.sum()), float(cmac[at].sum()), k, beta, name, None if math.isnan(p) else float(p)) for (beta, name), p in zip(labels, ps, strict=True)]
        return pd.DataFrame(out, columns=["trait", "gene_name", "mask", "n_variants", "cmac", "test", "beta", "annotation", "p"])

    keys = ["trait", "gene_name"]
    return rows.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInPandas(test, _LONG)


def burden_statistics(calls: DataFrame, null: NullModel, members: DataFrame, imputation: str = "mean", cutoff: float = 0.01) -> DataFrame:
    """trait, gene_name, mask, n_variants, score, variance, skat_q, cmac of unweighted burdens, by joins and sums only."""
    scored = scores(calls, null, imputation)
    rare = stored(rare_members(members, scored, cutoff), "members")
    per_mask = rare.join(scored, ["trait", "variant_idx"]).groupBy("trait", "gene_name", "mask").agg(
        F.count(F.lit(1)).alias("n_variants"),
        F.sum("score").alias("score"),
        F.sum(F.col("score") * F.col("score")).alias("skat_q"),
        F.sum(cumulative_mac("test_maf", imputation)).alias("cmac"),
        F.sum("base").alias("base"),
        F.sum("e_w1").alias("e_w1"),
        F.array(*(F.sum(F.col("cross")[i]) for i in range(null.p))).alias("cross"),
        F.first("w0").alias("w0"),
        F.first("cov").alias("cov"),
    )
    cells = oriented_cells(calls, null, scored.join(rare.select("trait", "variant_idx").distinct(), ["trait", "variant_idx"], "left_semi"))
    place = ["trait", "gene_name", "mask", "sample_idx"]
    burdens = cells.join(rare, ["trait", "variant_idx"]).groupBy(*place).agg(F.sum("e").alias("e"), F.first("w").alias("w"))
    if null.pairs is None:
        burdens = burdens.withColumn("we", F.col("w") * F.col("e"))
    else:
        burdens = burdens.join(weighted_cells(cells, null).join(rare, ["trait", "variant_idx"]).groupBy(*place).agg(F.sum("we").alias("we")), place)
    squares = burdens.groupBy("trait", "gene_name", "mask").agg(F.sum(F.col("we") * F.col("e")).alias("ee"))
    whole = F.col("base") * F.col("base") * F.col("w0") + 2 * F.col("base") * F.col("e_w1") + F.coalesce("ee", F.lit(0.0))
    return per_mask.join(squares, ["trait", "gene_name", "mask"], "left").select(
        "trait", "gene_name", "mask", "n_variants", "score", (whole - quadratic(F.col("cross"), F.col("cov"), null.p)).alias("variance"), "skat_q", "cmac"
    )


def omnibus(long: DataFrame) -> DataFrame:
    """Combined p-values of every trait and mask: WGS-S/B/A per frequency weight, ACAT-O of the six base tests, WGS-O of all."""
    key = ["trait", "gene_name", "mask"]
    per_test = long.groupBy(*key, "test", "beta").agg(cauchy("p").alias("p")).select(*key, F.concat(F.lit("WGS-"), "test", F.lit("("), "beta", F.lit(")")).alias("name"), "p")
    base = long.filter("annotation = ''").groupBy(*key).agg(cauchy("p").alias("p")).select(*key, F.lit("ACAT-O").alias("name"), "p")
    whole = long.groupBy(*key).agg(cauchy("p").alias("p")).select(*key, F.lit("WGS-O").alias("name"), "p")
    return per_test.unionByName(base).unionByName(whole)


def column_order(names: Sequence[str], tests: Sequence[str] = ("S", "B", "A")) -> list[str]:
    out = []
    for t in tests:
        for beta in BETAS:
            base = f"{TESTS[t]}({beta})"
            out += [base, *(f"{base}-{n}" for n in names), f"WGS-{t}({beta})"]
    return [*out, "ACAT-O", "WGS-O"]


def wide(long: DataFrame, names: Sequence[str], chrom: str | None = None) -> DataFrame:
    """One row per trait and mask with the elementary and combined p-values as columns, in their fixed order."""
    key = ["trait", "gene_name", "mask"]
    label = {k: F.lit(v) for k, v in TESTS.items()}
    test = F.when(F.col("test") == "S", label["S"]).when(F.col("test") == "B", label["B"]).otherwise(label["A"])
    name = F.concat(test, F.lit("("), "beta", F.lit(")"), F.when(F.col("annotation") != "", F.concat(F.lit("-"), "annotation")).otherwise(""))
    every = long.select(*key, name.alias("name"), "p").unionByName(omnibus(long))
    columns = column_order(names)
    table = every.groupBy(*key).pivot("name", columns).agg(F.first("p"))
    sizes = long.groupBy(*key).agg(F.first("n_variants").alias("#SNV"), F.first("cmac").alias("cMAC"))
    return sizes.join(table, key).select("trait", F.col("gene_name").alias("Gene name"), F.lit(chrom).alias("Chr"), F.col("mask").alias("Category"), "#SNV", "cMAC", *(f"`{c}`" for c in columns))


def with_disruptive(long: DataFrame) -> DataFrame:
    """Combined p-values of missense masks once the disruptive ones' base tests join them.

    trait, gene_name, name, p: the six '<test>(<beta>)-Disruptive' values (1 where the gene has no
    disruptive mask), the WGS summaries and WGS-O over them, and ACAT-O as it was.
    """
    key = ["trait", "gene_name"]
    missense = long.filter("mask = 'missense'").drop("mask")
    base = missense.filter("annotation = ''").select(*key, "test", "beta")
    disruptive = long.filter("mask = 'disruptive_missense' and annotation = ''").select(*key, "test", "beta", F.col("p").alias("p"), F.lit(True).alias("has"))
    added = base.join(disruptive, [*key, "test", "beta"], "left").select(*key, "test", "beta", F.lit("Disruptive").alias("annotation"), F.when(F.col("has"), F.col("p")).otherwise(1.0).alias("p"), "has")
    together = missense.select(*key, "test", "beta", "annotation", "p").unionByName(added.filter("has").drop("has"))
    combined = omnibus(together.withColumn("mask", F.lit("missense"))).filter("name <> 'ACAT-O'").drop("mask")
    unchanged = omnibus(missense.withColumn("mask", F.lit("missense"))).filter("name = 'ACAT-O'").drop("mask")
    test = F.when(F.col("test") == "S", "SKAT").when(F.col("test") == "B", "Burden").otherwise("ACAT-V")
    own = added.select(*key, F.concat(test, F.lit("("), "beta", F.lit(")-Disruptive")).alias("name"), "p")
    return own.unionByName(combined).unionByName(unchanged)


def disruptive_columns(tests: Sequence[str] = ("S", "B", "A")) -> list[str]:
    return [f"{TESTS[t]}({beta})-Disruptive" for t in tests for beta in BETAS]


def wide_with_disruptive(long: DataFrame, names: Sequence[str], chrom: str | None = None) -> DataFrame:
    """``wide`` with the '-Disruptive' columns at its end; missense rows take the summaries of ``with_disruptive``."""
    table = wide(long, names, chrom)
    changed = [f"WGS-{t}({beta})" for t in TESTS for beta in BETAS] + ["WGS-O"]
    extra = with_disruptive(long).groupBy("trait", "gene_name").pivot("name", [*disruptive_columns(), *changed]).agg(F.first("p"))
    extra = extra.select("trait", F.col("gene_name").alias("Gene name"), F.lit("missense").alias("Category"), F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(extra.columns[2:]))).alias("_new"))
    place = {c: F.col(f"_new.c{i}") for i, c in enumerate([*disruptive_columns(), *changed])}
    kept = [F.when(F.col("_new").isNotNull(), place[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in changed else F.col(f"`{c}`") for c in table.columns]
    return table.join(extra, ["trait", "Gene name", "Category"], "left").select(*kept, *(place[c].alias(c) for c in disruptive_columns()))


def binary_burdens(calls: DataFrame, null: NullModel, variants: DataFrame, members: DataFrame, phred: Column, names: Sequence[str], cutoff: float = 0.01, at_least: int = 2, p_filter: float = 0.05, imputation: str = "mean", tol: float = 2.0**-13) -> DataFrame:
    """Burden p-values of binary traits: normal ones, and by saddlepoint where these are below ``p_filter``.

    trait, gene_name, mask, n_variants, cmac, beta, annotation, score, variance, p_normal, p. No
    variant covariance is built: each weighted burden is summed per sample by Spark. Under a mixed
    model variances and projections are those of its precision matrix, the saddlepoint takes its means.
    """
    scored = scores(calls, null, imputation)
    rare = stored(rare_members(members, scored, cutoff, at_least), "members")
    labels = _labels(names)
    label = F.array(*(F.struct(F.lit(b).alias("beta"), F.lit(n).alias("annotation")) for b, n in labels))
    mask = ["trait", "gene_name", "mask"]
    weighted = stored(
        rare.join(scored, ["trait", "variant_idx"])
        .join(variants.select("variant_idx", phred.alias("phred")), "variant_idx")
        .select(*mask, "variant_idx", "score", "cross", "base", "e_w1", "w0", "cov", cumulative_mac("test_maf", imputation).alias("cmac"), association_weights(F.col("test_maf"), F.col("phred"))["B"].alias("b")),
        "weighted",
    )
    b = F.col("b")
    per_mask = weighted.select("*", F.posexplode("b").alias("at", "one")).drop("b").withColumnRenamed("one", "b").groupBy(*mask, "at").agg(
        F.count(F.lit(1)).cast("int").alias("n_variants"), F.sum("cmac").alias("cmac"), F.sum(b * F.col("score")).alias("score"), F.sum(b * F.col("base")).alias("base"), F.sum(b * F.col("e_w1")).alias("e_w1"),
        F.array(*(F.sum(b * F.col("cross")[i]) for i in range(null.p))).alias("cross"), F.first("w0").alias("w0"), F.first("cov").alias("cov"),
    )
    cells = oriented_cells(calls, null, scored.join(rare.select("trait", "variant_idx").distinct(), ["trait", "variant_idx"], "left_semi"))
    burdens = F.array(*(F.sum(b[i] * F.col("e")) for i in range(len(labels)))).alias("es")
    per_sample = stored(cells.join(weighted.select(*mask, "variant_idx", "b"), ["trait", "variant_idx"]).groupBy(*mask, "sample_idx").agg(burdens, F.first("w").alias("w")), "burdens")
    products = per_sample.withColumn("wes", F.transform("es", lambda e: F.col("w") * e))
    if null.pairs is not None:
        weighed = F.array(*(F.sum(b[i] * F.col("we")) for i in range(len(labels)))).alias("wes")
        products = per_sample.join(weighted_cells(cells, null).join(weighted.select(*mask, "variant_idx", "b"), ["trait", "variant_idx"]).groupBy(*mask, "sample_idx").agg(weighed), [*mask, "sample_idx"])
    squares = products.groupBy(*mask).agg(F.array(*(F.sum(F.col("wes")[i] * F.col("es")[i]) for i in range(len(labels)))).alias("ees"))
    whole = F.col("base") * F.col("base") * F.col("w0") + 2 * F.col("base") * F.col("e_w1") + F.coalesce(F.get("ees", F.col("at")), F.lit(0.0))
    nominal = per_mask.join(squares, mask, "left").withColumn("variance", whole - quadratic(F.col("cross"), F.col("cov"), null.p))
    nominal = stored(with_normal_p(nominal, "p_normal").drop("w0", "cov", "ees", "e_w1"), "nominal")
    chosen = nominal.filter(F.col("p_normal") < p_filter).select(*mask, "at", "score", "base", "cross")
    carriers = per_sample.join(chosen.select(*mask, "at"), mask).withColumn("e", F.get("es", F.col("at"))).select(*mask, "at", "sample_idx", "e")
    corrected = saddlepoint_p(chosen, carriers, null, [*mask, "at"], tol)
    named = F.get(label, F.col("at"))
    return nominal.join(corrected, [*mask, "at"], "left").select(*mask, named["beta"].alias("beta"), named["annotation"].alias("annotation"), "n_variants", "cmac", "score", "variance", "p_normal", F.coalesce("p_spa", "p_normal").alias("p"))


def with_normal_p(rows: DataFrame, name: str) -> DataFrame:
    """Adds the chi-square p-value of score and variance; null without variance."""
    deviate = F.abs("score") / F.sqrt(2 * F.when(F.col("variance") > 0, F.col("variance")))
    return rows.withColumn("_deviate", deviate).withColumn(name, erfc(F.col("_deviate"))).drop("_deviate")


def binary_summaries(burdens: DataFrame) -> DataFrame:
    """trait, gene_name, mask, name, p: WGS-B per frequency weight and over all, combining saddlepoint p-values."""
    key = ["trait", "gene_name", "mask"]
    per_beta = burdens.groupBy(*key, "beta").agg(cauchy_spa("p").alias("p")).select(*key, F.concat(F.lit("WGS-B("), "beta", F.lit(")")).alias("name"), "p")
    return per_beta.unionByName(burdens.groupBy(*key).agg(cauchy_spa("p").alias("p")).select(*key, F.lit("WGS-B").alias("name"), "p"))


def binary_with_disruptive(burdens: DataFrame) -> DataFrame:
    """trait, gene_name, name, p of missense masks once the disruptive ones' base burdens join them.

    'Burden(<beta>)-Disruptive' (1 where the gene has no disruptive mask or its p is missing) and,
    where it has one, the WGS-B summaries over all.
    """
    key = ["trait", "gene_name"]
    missense = burdens.filter("mask = 'missense'").select(*key, "mask", "beta", "annotation", "p")
    disruptive = burdens.filter("mask = 'disruptive_missense' and annotation = ''").select(*key, "beta", "p", F.lit(True).alias("has"))
    base = missense.filter("annotation = ''").select(*key, "mask", "beta")
    added = base.join(disruptive, [*key, "beta"], "left").select(*key, "mask", "beta", F.lit("Disruptive").alias("annotation"), F.coalesce(F.nanvl("p", F.lit(1.0)), F.lit(1.0)).alias("p"), "has")
    together = missense.join(added.filter("has").select(*key).distinct(), key, "left_semi").unionByName(added.filter("has").drop("has"))
    own = added.select(*key, F.concat(F.lit("Burden("), "beta", F.lit(")-Disruptive")).alias("name"), "p")
    return own.unionByName(binary_summaries(together).drop("mask"))


def binary_names(burdens: DataFrame) -> DataFrame:
    """``binary_summaries`` of every mask, those of missense masks over their disruptive burdens too (with these as rows)."""
    extra = binary_with_disruptive(burdens).select("trait", "gene_name", F.lit("missense").alias("mask"), "name", "p")
    plain = binary_summaries(burdens)
    return plain.join(extra, ["trait", "gene_name", "mask", "name"], "left_anti").select(extra.columns).unionByName(extra)


def binary_single(calls: DataFrame, null: NullModel, mac_cutoff: float = 20, p_filter: float = 0.05, imputation: str = "mean", tol: float = 2.0**-13) -> DataFrame:
    """trait, variant_idx, score, variance, p_normal, p of binary traits; p by saddlepoint where p_normal < ``p_filter``.

    A p of exactly 0 is kept and marked by ``unverified``.
    """
    key = ["trait", "variant_idx"]
    scored = scores(calls, null, imputation).filter(F.col("initial_mac") >= mac_cutoff).filter("maf > 0 and maf < 1 and variance > 0 and family = 'binomial'")
    nominal = with_normal_p(scored, "p_normal").select(*key, "score", "variance", "p_normal", "base", "sign", "fill", "cross")
    chosen = stored(nominal.filter(F.col("p_normal") < p_filter), "chosen")
    carriers = oriented_cells(calls, null, chosen).select(*key, "sample_idx", "e")
    corrected = saddlepoint_p(chosen, carriers, null, key, tol)
    joined = nominal.join(corrected, key, "left").withColumn("p", F.coalesce("p_spa", "p_normal"))
    return joined.select(*key, "score", "variance", "p_normal", "p", (F.col("p") == 0).alias("unverified"))
