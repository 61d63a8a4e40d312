"""The two whole-study calls: prepare a dataset from files, and run every analysis of its traits."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations, association, genotypes, identity, joint, kinship, masks, null_models, set_tests
from ..operators.ranking import inverse_normal
from ..session import ship_package, stored
from ..sources import files, plink

_TABLES = ("samples", "variants", "calls", "variant_stats", "genes", "ncrnas", "promoters")
#: Layout of prepared datasets.
VERSION = 2


def prepare(spark: SparkSession, prefixes: dict[str, str], manifest: str, annotation_files: dict[str, str], genes: str, ncrnas: str, promoters: str, output: str) -> None:
    """Write samples, variants, calls and references of PLINK filesets as Parquet, calls partitioned by chromosome.

    ``prefixes`` and ``annotation_files`` are per chromosome. Variants are numbered through the whole
    study, chromosome by chromosome. Any rejected FAM, BIM, gene or promoter line, differing sample
    lists, repeated or missing annotations and bad scores stop the run before anything is written.
    The table ``dataset`` comes last and marks a complete dataset.
    """
    ship_package(spark)
    parts: dict[str, list[DataFrame]] = {t: [] for t in _TABLES}
    axis, first = None, 0
    for chrom, prefix in sorted(prefixes.items()):
        settings = files.read_manifest(manifest, chrom)
        fam = stored(plink.read_fam(spark, f"{prefix}.fam"), "fam")
        bim = plink.read_bim(spark, f"{prefix}.bim", chrom, settings.get("reference_allele_source") == "a1")
        bim = stored(bim.withColumn("variant_idx", F.col("variant_idx") + first), "bim")
        _refuse(fam.filter("problem is not null"), f"{prefix}.fam")
        _refuse(bim.filter("problem is not null"), f"{prefix}.bim")
        _refuse(identity.axis_problems(fam), f"{prefix}.fam")
        these = fam.select("sample_idx", "fid", "iid")
        if axis is not None and not (axis.exceptAll(these).isEmpty() and these.exceptAll(axis).isEmpty()):
            raise ValueError(f"{prefix}.fam lists other samples than the first chromosome")
        axis = axis or these
        mapping = settings["column_mapping"]
        raw = files.read_annotations(spark, annotation_files[chrom], mapping).withColumn("pos", F.col("pos").cast("bigint"))
        raw = raw.filter(masks.chromosome("chrom") == chrom).drop("chrom")
        exact = settings.get("allele_order") == "ref_alt"
        _refuse(annotations.annotation_problems(bim, raw, "a1", "a2", bool(settings.get("allow_missing_non_snv"))), annotation_files[chrom])
        for name in settings["annotation_names"]:
            _refuse(annotations.bad_scores(raw, name), f"{annotation_files[chrom]}: {name}")
        fields = [f for f in mapping if f not in ("chrom", "pos", "a1", "a2")]
        scores = settings["annotation_names"]
        joined = annotations.join_annotations(bim.drop("problem", "id"), raw, fields, "a1", "a2", exact)
        joined = joined.withColumns({s: annotations.score(F.col(f"`{s}`")) for s in scores})
        if "qc" not in fields:
            joined = joined.withColumn("qc", F.lit(settings.get("default_qc", "PASS")))
        n_samples, n_variants = fam.count(), bim.count()
        calls = plink.read_bed(spark, f"{prefix}.bed", n_samples, n_variants, settings.get("reference_allele_source") == "a1")
        calls = calls.withColumns({"variant_idx": F.col("variant_idx") + first, "chrom": F.lit(chrom)})
        own_genes = files.read_genes(spark, genes, chrom)
        _refuse(own_genes.filter("problem is not null"), genes)
        parts["variants"].append(joined)
        parts["calls"].append(calls)
        parts["variant_stats"].append(genotypes.complete(genotypes.allele_counts(calls, n_samples), bim, n_samples).withColumn("chrom", F.lit(chrom)))
        parts["genes"].append(own_genes)
        parts["ncrnas"].append(files.read_ncrnas(spark, ncrnas, chrom))
        first += n_variants
    parts["samples"].append(axis.withColumn("sample_key", identity.sample_key("fid", "iid")))
    intervals = files.read_promoters(spark, promoters)
    _refuse(intervals.filter("chrom is null or start_pos is null or end_pos is null or start_pos > end_pos"), promoters)
    parts["promoters"].append(intervals)
    for name, frames in parts.items():
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        writer = whole.write.option("compression", "zstd")
        if name in ("variants", "calls", "variant_stats"):
            writer = writer.partitionBy("chrom")
        writer.parquet(f"{output}/{name}")
    sizes = [(name, VERSION, *_print_of(_read(spark, output, name))) for name in _TABLES]
    spark.createDataFrame(sizes, "table_name string, version int, n_rows bigint, print string").coalesce(1).write.parquet(f"{output}/dataset")


def _refuse(problems: DataFrame, where: str) -> None:
    first = problems.limit(5).collect()
    if first:
        raise ValueError(f"{where}: {[r.asDict() for r in first]}")


def _print_of(df: DataFrame) -> tuple[int, str]:
    """Number of rows, and a sum of row hashes that tells different contents apart whatever their order."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(20,0)"))).first()  # one row
    return n, str(total)


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    df = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    return df.withColumn("chrom", F.col("chrom").cast("string")) if "chrom" in df.columns else df


class Dataset:
    """A prepared dataset, one DataFrame per table; ``chromosomes`` prune those that have one.

    A dataset without its final table, of another layout, or with a broken sample axis is refused.
    """

    def __init__(self, spark: SparkSession, path: str, chromosomes: Sequence[str] | None = None):
        try:
            known = {r["table_name"]: r for r in spark.read.parquet(f"{path}/dataset").collect()}  # a row per table
        except AnalysisException as missing:
            raise ValueError(f"{path} is no complete dataset") from missing
        if set(known) != set(_TABLES) or any(r["version"] != VERSION for r in known.values()):
            raise ValueError(f"{path} has another layout")
        self.prints = {name: r["print"] for name, r in known.items()}
        for name in _TABLES:
            df = _read(spark, path, name)
            if "chrom" in df.columns and chromosomes is not None:
                df = df.filter(F.col("chrom").isin([str(c) for c in chromosomes]))
            setattr(self, name, df)
        ends = self.samples.agg(F.min("sample_idx"), F.max("sample_idx"), F.count_distinct("sample_idx"), F.count(F.lit(1))).first()  # one row
        if ends[3] == 0 or ends[0] != 0 or not ends[1] + 1 == ends[2] == ends[3]:
            raise ValueError(f"{path} has a broken sample axis")


def designs_of(data: Dataset, phenotypes: DataFrame, covariates: DataFrame, traits: dict[str, Sequence[str]]) -> list[tuple[DataFrame, int]]:
    """Long designs (trait, sample_idx, y, x0 ..) of complete cases, one per number of columns, with that number.

    ``traits`` maps phenotypes to covariates. Traits with the same covariates are built together. An
    intercept goes in front unless a covariate is 1 for all of a trait's samples.
    """
    axis = data.samples.select("sample_idx", "fid", "iid")
    whole = axis.join(phenotypes, ["fid", "iid"])
    sets: dict[tuple[str, ...], list[str]] = {}
    for trait, names in traits.items():
        sets.setdefault(tuple(names), []).append(trait)
    by_width: dict[int, list[DataFrame]] = {}
    for names, own in sets.items():
        y = whole.select("sample_idx", "fid", "iid", *(F.col(f"`{t}`").alias(f"y{i}") for i, t in enumerate(own)))
        rows = y.join(covariates.select("fid", "iid", *(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names))), ["fid", "iid"])
        labels = F.array(*(F.struct(F.lit(t).alias("trait"), F.col(f"y{i}").alias("y")) for i, t in enumerate(own)))
        columns = [f"c{i}" for i in range(len(names))]
        long = stored(rows.select("sample_idx", *columns, F.explode(labels).alias("o")).select("o.trait", "sample_idx", "o.y", *columns).dropna(), "cases")
        needy = {r["trait"] for r in null_models.needs_intercept(long, columns).collect() if r["needs_intercept"]} if columns else set(own)  # a row per trait
        for intercept, chosen in ((True, [t for t in own if t in needy]), (False, [t for t in own if t not in needy])):
            if chosen:
                x = [*([F.lit(1.0)] if intercept else []), *map(F.col, columns)]
                part = long.filter(F.col("trait").isin(chosen)).select("trait", "sample_idx", "y", *(c.alias(f"x{i}") for i, c in enumerate(x)))
                by_width.setdefault(len(x), []).append(part)
    return [(stored(reduce(DataFrame.unionByName, frames), "design"), p) for p, frames in sorted(by_width.items())]


def _saved_report(spark: SparkSession, place: str) -> dict | None:
    try:
        return json.loads(spark.read.text(place, wholetext=True).first()["value"])
    except AnalysisException:
        return None


def run_all(spark: SparkSession, phenotype_csv: str, covariate_csv: str, prepared: str, output: str, traits: dict[str, Sequence[str]] | None = None, families: dict[str, str] | None = None, chromosomes: Sequence[str] | None = None, analyses: Sequence[str] = ("single", "coding", "noncoding", "ncrna"), annotation_names: Sequence[str] = (), transform: str = "none", null_fit_mode: str = "ordinary", grm: tuple[DataFrame, DataFrame] | None = None, gene_variant_type: str = "SNV", mac_cutoff: float = 20, rare_maf_cutoff: float = 0.01, rv_num_cutoff: int = 2, imputation: str = "mean", long_mask_threshold: int = 5000, long_mask_rank: int = 512, maximum_mask_variants: int | None = None, joint_groups: Sequence[Sequence[str]] = ()) -> dict:
    """Fit the null models of all traits and write every analysis under ``output``; returns (and writes) a report of row counts.

    ``traits`` maps phenotype to covariate columns (default: all of both; they may differ by trait),
    ``families`` overrides the family that 0/1 values imply, ``transform`` is none, rint or paper for
    continuous traits, ``null_fit_mode`` ordinary or mixed (with ``grm`` = diagonal, edges). Binary
    traits have burdens only, with saddlepoint p-values in single-variant tests and burdens. Each of
    ``joint_groups`` names continuous traits with the same covariates that are also tested together
    (by least squares, as one trait named after all of them). Gene tables are in the order of chromosomes and of the gene list. An output with the report of the
    same inputs and parameters is not written again; one of others is an error.
    """
    ship_package(spark)
    data = Dataset(spark, prepared, chromosomes)
    phenotypes, bad_p = files.read_traits(spark, phenotype_csv)
    covariates, bad_c = files.read_traits(spark, covariate_csv)
    _refuse(bad_p, phenotype_csv)
    _refuse(bad_c, covariate_csv)
    if traits is None:
        names = [c for c in covariates.columns if c not in ("fid", "iid")]
        traits = {t: names for t in phenotypes.columns if t not in ("fid", "iid")}
    settings = {
        "dataset": data.prints, "phenotypes": _print_of(phenotypes), "covariates": _print_of(covariates), "grm": [_print_of(g) for g in grm or ()], "traits": {t: list(c) for t, c in traits.items()}, "families": families, "chromosomes": chromosomes,
        "analyses": sorted(analyses), "annotation_names": list(annotation_names), "transform": transform, "null_fit_mode": null_fit_mode, "gene_variant_type": gene_variant_type, "mac_cutoff": mac_cutoff, "rare_maf_cutoff": rare_maf_cutoff, "rv_num_cutoff": rv_num_cutoff,
        "imputation": imputation, "long_mask_threshold": long_mask_threshold, "long_mask_rank": long_mask_rank, "maximum_mask_variants": maximum_mask_variants, "joint_groups": [list(g) for g in joint_groups],
    }
    mark = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()
    before = _saved_report(spark, f"{output}/report")
    if before is not None:
        if before["identity"] != mark:
            raise ValueError(f"{output} holds the results of other inputs or parameters")
        return before
    if gene_variant_type != "SNV" and "annotation_available" in data.variants.columns:
        _refuse(data.variants.filter("not annotation_available and (length(ref) <> 1 or length(alt) <> 1)").select("chrom", "pos", "ref", "alt"), "variants without annotation")

    calls, variants = data.calls.drop("chrom"), data.variants
    phred, names = annotations.phred_columns(variants.columns, list(annotation_names), gene_variant_type)
    members = {
        "coding": lambda: masks.coding_masks(variants, data.genes, gene_variant_type),
        "noncoding": lambda: masks.noncoding_masks(variants, data.promoters, data.genes, gene_variant_type, include_ncrna=False),
        "ncrna": lambda: masks.noncoding_masks(variants, data.promoters, data.ncrnas, gene_variant_type).filter("mask = 'ncRNA'"),
    }
    members = {kind: stored(_by_chromosome(rows(), variants), "members") for kind, rows in members.items() if kind in analyses}
    results: dict[str, list[DataFrame]] = {}
    found: dict[str, str] = {}
    waiting = [tuple(g) for g in joint_groups]
    for design, p in designs_of(data, phenotypes, covariates, traits):
        family_of = {r["trait"]: r["family"] for r in identity.quality_summary(design).collect()}  # a row per trait
        family_of |= {t: f for t, f in (families or {}).items() if t in family_of}
        found |= family_of
        for family in sorted(set(family_of.values())):
            rows = design.filter(F.col("trait").isin([t for t, f in family_of.items() if f == family]))
            if family == "gaussian" and transform != "none":
                rows = null_models.residual_inverse_normal(rows, p) if transform == "paper" else _rint(rows)
            for group in [g for g in waiting if family == "gaussian" and all(family_of.get(t) == family for t in g)]:
                waiting.remove(group)
                for kind, table in _joint_results(calls, joint.fit_joint(rows, group, p), variants, members, phred, names, "single" in analyses, mac_cutoff, rare_maf_cutoff, rv_num_cutoff, imputation).items():
                    results.setdefault(kind, []).append(table.withColumn("trait", F.lit("+".join(group))))
            if null_fit_mode == "mixed":
                fit = kinship.fit_mixed_linear if family == "gaussian" else kinship.fit_mixed_logistic
                null = fit(rows, *kinship.subset(*grm, rows), p)
            else:
                null = (null_models.fit_linear if family == "gaussian" else null_models.fit_logistic)(rows, p)
            if "single" in analyses:
                single = association.single_variant(calls, null, variants, mac_cutoff, imputation=imputation)
                if family == "binomial":
                    single = _with_saddlepoint(single, set_tests.binary_single(calls, null, mac_cutoff, imputation=imputation))
                results.setdefault("single", []).append(single)
            for kind, of_kind in members.items():
                if family == "gaussian":
                    long = stored(set_tests.set_tests(calls, null, variants, of_kind, phred, names, rare_maf_cutoff, rv_num_cutoff, maximum_mask_variants, imputation, long_mask_threshold, long_mask_rank), "tests")
                    shape = set_tests.wide_with_disruptive if kind == "coding" else set_tests.wide
                    results.setdefault(kind, []).append(shape(long, names))
                else:
                    burdens = stored(set_tests.binary_burdens(calls, null, variants, of_kind, phred, names, rare_maf_cutoff, rv_num_cutoff, imputation=imputation), "binary")
                    results.setdefault(f"{kind}_binary", []).append(burdens.drop("score", "variance"))
                    results.setdefault(f"{kind}_binary_summaries", []).append(set_tests.binary_names(burdens))

    if waiting:
        raise ValueError(f"joint traits need the same covariates and continuous values: {waiting}")
    report = {"identity": mark, "traits": found, "rows": {}}
    for name, frames in results.items():
        table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        if name in ("single", "single_joint"):
            table = stored(table, name)
            order = [F.col("trait"), *_chromosome_order("chrom"), *(F.col(c) for c in association.SINGLE_ORDER[2:] if c in table.columns)]
        else:
            gene = "Gene name" if "Gene name" in table.columns else "gene_name"
            table = stored(_in_catalogue(table, gene, data.ncrnas if name.startswith("ncrna") else data.genes), name)
            order = [F.col("trait"), *_chromosome_order("Chr"), F.col("_ordinal"), F.col("Category" if gene == "Gene name" else "mask"), *(F.col(c) for c in ("beta", "annotation", "name") if c in table.columns)]
            if name in ("noncoding", "ncrna"):
                table = files.gene_rows_as_text(table)
        files.write_results(table, f"{output}/{name}", order)
        report["rows"][name] = table.count()
    spark.createDataFrame([(json.dumps(report, indent=1),)], "value string").coalesce(1).write.text(f"{output}/report")
    return report


def _joint_results(calls: DataFrame, model: joint.JointModel, variants: DataFrame, members: dict[str, DataFrame], phred: Column, names: Sequence[str], single: bool, mac_cutoff: float, cutoff: float, at_least: int, imputation: str) -> dict[str, DataFrame]:
    """Single-variant and mask results of traits tested together; masks in long form, elementary and combined."""
    out = {}
    if single:
        out["single_joint"] = joint.joint_single(calls, model, mac_cutoff, imputation).join(variants.select("variant_idx", "chrom", "pos", "ref", "alt"), "variant_idx")
    test = F.element_at(F.create_map(*(F.lit(x) for pair in set_tests.TESTS.items() for x in pair)), F.col("test"))
    name = F.concat(test, F.lit("("), "beta", F.lit(")"), F.when(F.col("annotation") != "", F.concat(F.lit("-"), "annotation")).otherwise(""))
    for kind, of_kind in members.items():
        long = stored(joint.joint_set_tests(calls, model, variants, of_kind, phred, names, cutoff, at_least, imputation), "joint")
        each = long.select("gene_name", "mask", name.alias("name"), "p")
        out[f"{kind}_joint"] = each.unionByName(set_tests.omnibus(long.withColumn("trait", F.lit(""))).drop("trait"))
    return out


def _by_chromosome(members: DataFrame, variants: DataFrame) -> DataFrame:
    """Members whose gene_name carries its chromosome, so that genes of one name on two chromosomes stay apart."""
    return members.join(variants.select("variant_idx", "chrom"), "variant_idx").select(F.concat_ws(":", "chrom", "gene_name").alias("gene_name"), "mask", "variant_idx")


def _in_catalogue(table: DataFrame, gene: str, catalogue: DataFrame) -> DataFrame:
    """``table`` with the chromosome (Chr) and name of its genes apart, and their place in the catalogue (_ordinal)."""
    place = catalogue.groupBy(F.concat_ws(":", "chrom", "gene_name").alias(gene)).agg(F.min("ordinal").alias("_ordinal"))
    rows = table.join(place, gene, "left")
    chrom, name = F.substring_index(F.col(f"`{gene}`"), ":", 1), F.expr(f"substring(`{gene}`, instr(`{gene}`, ':') + 1)")
    columns = [c for c in table.columns if c != "Chr"]
    at = columns.index(gene)
    return rows.select(*(F.col(f"`{c}`") for c in columns[:at]), name.alias(gene), chrom.alias("Chr"), *(F.col(f"`{c}`") for c in columns[at + 1 :]), "_ordinal")


def _chromosome_order(column: str) -> list:
    """Numbered chromosomes by number, then all others by name."""
    return [F.col(column).try_cast("int").asc_nulls_last(), F.col(column)]


def _with_saddlepoint(single: DataFrame, spa: DataFrame) -> DataFrame:
    """Single-variant rows whose final p is that of ``binary_single``, with the normal one beside it; a p of 0 has an infinite, unverified logarithm."""
    rows = single.join(spa.select("trait", "variant_idx", "p_normal", F.col("p").alias("_p"), "unverified"), ["trait", "variant_idx"], "left")
    changed = F.col("_p").isNotNull() & (F.col("_p") != F.col("p_normal"))
    log_p = F.when(F.col("_p") == 0, F.lit(float("inf"))).otherwise(-F.log10("_p"))
    final = {"pvalue": F.when(changed, F.col("_p")).otherwise(F.col("pvalue")), "pvalue_log10": F.when(changed, log_p).otherwise(F.col("pvalue_log10"))}
    return rows.select(*(final.get(c, F.col(c)).alias(c) for c in single.columns), F.when(F.col("_p").isNotNull(), F.col("pvalue")).alias("normal_pvalue"), F.when(F.col("_p").isNotNull(), F.col("pvalue_log10")).alias("normal_pvalue_log10"), "unverified")


def _rint(rows: DataFrame) -> DataFrame:
    return inverse_normal(rows, ["trait"], "y").withColumn("y", F.col("rint")).drop("rank", "n", "rint")
