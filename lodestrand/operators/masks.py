"""Which variants belong to which gene masks, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import range_join
from .skew import skew_join

# Fixed names of the masks, in output order, and of the annotation values they select.
CODING = ("plof", "plof_ds", "missense", "disruptive_missense", "synonymous")
PTV = ("ptv", "ptv_ds")
NONCODING = ("upstream", "downstream", "UTR", "promoter_CAGE", "promoter_DHS", "enhancer_CAGE", "enhancer_DHS")
STOP = ("stopgain", "stoploss")
CODING_SPLICE = ("splicing", "exonic;splicing")
SPLICE = (*CODING_SPLICE, "ncRNA_splicing", "ncRNA_exonic;splicing")
FRAMESHIFT = ("frameshift deletion", "frameshift insertion")
UTRS = ("UTR3", "UTR5", "UTR5;UTR3")
NCRNAS = ("ncRNA_exonic", "ncRNA_exonic;splicing", "ncRNA_splicing")


def chromosome(name: Column | str) -> Column:
    """Upper case without a leading 'chr'."""
    column = F.col(name) if isinstance(name, str) else name
    return F.upper(F.regexp_replace(column, "(?i)^chr", ""))


def passing(variant_type: str = "SNV") -> Column:
    """QC passed, and one base each for SNV, anything else for Indel, no matter for variant."""
    single = (F.length("ref") == 1) & (F.length("alt") == 1)
    kinds = {"SNV": single, "Indel": ~single, "variant": F.lit(True)}
    return (F.col("qc") == "PASS") & kinds[variant_type]


def _names(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, lambda t: t != ""))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def neighbour_genes() -> Column:
    return _names(F.split(_text("info"), ","))


def utr_genes() -> Column:
    return _names(F.array(F.substring_index(_text("info"), "(", 1)))


def promoter_genes() -> Column:
    return _names(F.array(F.get(F.split(_text("info"), r"[(,;\-]", 2), F.lit(0))))


def ncrna_genes() -> Column:
    """The first three names before a semicolon, bracketed detail removed."""
    bare = F.regexp_replace(F.substring_index(_text("info"), ";", 1), r"\(.*\)", "")
    return _names(F.slice(F.split(bare, ","), 1, 3))


def enhancer_genes() -> Column:
    """The fourth part between equal signs, up to a semicolon."""
    fourth = F.coalesce(F.get(F.split(_text("genehancer"), "="), F.lit(3)), F.lit(""))
    return _names(F.array(F.substring_index(fourth, ";", 1)))


def coding_conditions(variant_type: str = "SNV", include_ptv: bool = True) -> dict[str, Column]:
    category, exonic = _text("category"), _text("exonic")
    missense = exonic == "nonsynonymous SNV"
    disruptive = missense & (_text("metasvm") == "D")
    plof = exonic.isin(*STOP) | category.isin(*SPLICE)
    conditions = {"plof": plof, "plof_ds": plof | disruptive, "missense": missense, "disruptive_missense": disruptive, "synonymous": exonic == "synonymous SNV"}
    if include_ptv:
        by_base, by_frame = exonic.isin(*STOP) | category.isin(*CODING_SPLICE), exonic.isin(*FRAMESHIFT)
        ptv = {"SNV": by_base, "Indel": by_frame, "variant": by_base | by_frame}[variant_type]
        conditions |= {"ptv": ptv, "ptv_ds": ptv | disruptive}
    return conditions


def _masks_of(conditions: dict[str, Column]) -> Column:
    return F.explode(F.filter(F.array(*(F.when(c, name) for name, c in conditions.items())), lambda m: m.isNotNull()))


def coding_masks(variants: DataFrame, genes: DataFrame, variant_type: str = "SNV", include_ptv: bool = True) -> DataFrame:
    """(gene_name, mask, variant_idx) of passing variants within each gene's closed span."""
    base = variants.filter(passing(variant_type)).withColumn("mask", _masks_of(coding_conditions(variant_type, include_ptv)))
    spans = genes.select("gene_name", "chrom", "start_pos", "end_pos")
    return range_join(base.select("variant_idx", "chrom", "pos", "mask"), spans).select("gene_name", "mask", "variant_idx")


def gene_tokens(variants: DataFrame, promoter_intervals: DataFrame, variant_type: str = "SNV", include_ncrna: bool = True) -> DataFrame:
    """(gene_name, chrom, mask, variant_idx) of passing variants for every gene their annotations name, known or not."""
    base = variants.filter(passing(variant_type))
    category, cage, dhs = _text("category"), _text("cage") != "", _text("dhs") != ""
    enhanced = _text("genehancer") != ""
    plain = {
        "upstream": (category == "upstream", neighbour_genes()),
        "downstream": (category == "downstream", neighbour_genes()),
        "UTR": (category.isin(*UTRS), utr_genes()),
        "enhancer_CAGE": (enhanced & cage, enhancer_genes()),
        "enhancer_DHS": (enhanced & dhs, enhancer_genes()),
    }
    if include_ncrna:
        plain["ncRNA"] = (category.isin(*NCRNAS), ncrna_genes())
    promoting = {"promoter_CAGE": (cage, promoter_genes()), "promoter_DHS": (dhs, promoter_genes())}

    def exploded(rows: DataFrame, masks: dict[str, tuple[Column, Column]]) -> DataFrame:
        each = F.array(*(F.when(c, F.struct(F.lit(m).alias("mask"), g.alias("genes"))) for m, (c, g) in masks.items()))
        kept = rows.select("variant_idx", "chrom", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x"))
        return kept.select(F.explode("x.genes").alias("gene_name"), "chrom", "x.mask", "variant_idx")

    in_promoters = range_join(base, promoter_intervals.select("chrom", "start_pos", "end_pos"), how="left_semi")
    return exploded(base, plain).unionByName(exploded(in_promoters, promoting))


def noncoding_masks(variants: DataFrame, promoter_intervals: DataFrame, genes: DataFrame, variant_type: str = "SNV", include_ncrna: bool = True) -> DataFrame:
    """(gene_name, mask, variant_idx): ``gene_tokens`` of the genes that the catalogue (gene_name, chrom) has on the variant's chromosome."""
    tokens = gene_tokens(variants, promoter_intervals, variant_type, include_ncrna)
    return skew_join(tokens, genes.select("gene_name", "chrom").distinct(), ["gene_name", "chrom"], "left_semi").select("gene_name", "mask", "variant_idx")


def rare(members: DataFrame, stats: DataFrame, cutoff: float = 0.01, at_least: int = 2, at_most: int | None = None) -> DataFrame:
    """Members whose variants have 0 < maf < cutoff in ``stats`` (variant_idx, maf), of masks with enough of them.

    Masks below ``at_least`` give no rows, as do those above ``at_most`` where given.
    """
    kept = members.join(stats.filter(f"maf > 0 and maf < {cutoff!r}").select("variant_idx"), "variant_idx", "left_semi")
    sizes = kept.groupBy("gene_name", "mask").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") >= at_least)
    if at_most is not None:
        sizes = sizes.filter(F.col("_size") <= at_most)
    return kept.join(sizes.select("gene_name", "mask"), ["gene_name", "mask"], "left_semi")


def mask_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("gene_name", "mask").agg(F.count(F.lit(1)).alias("n_variants"))


def distinct_masks(members: DataFrame) -> DataFrame:
    """gene_name, mask, set_id, n_variants: masks with the same variants share the set_id, so each set is tested once.

    A set is recognised by its size, sum and two independent hash sums of its variants, which merge
    on the map side however large the mask is.
    """
    v = F.col("variant_idx")
    spread = lambda seed: F.sum(F.xxhash64(F.lit(seed), v).cast("decimal(20,0)"))
    prints = members.groupBy("gene_name", "mask").agg(F.count(F.lit(1)).alias("n_variants"), F.sum(v).alias("s"), spread(1).alias("h1"), spread(2).alias("h2"))
    first = prints.groupBy("n_variants", "s", "h1", "h2").agg(F.min(F.struct("gene_name", "mask")).alias("first"))
    return prints.join(first, ["n_variants", "s", "h1", "h2"]).select("gene_name", "mask", F.concat_ws("/", "first.gene_name", "first.mask").alias("set_id"), "n_variants")


def promoters_from_transcripts(transcripts: DataFrame, gene_of: DataFrame, upstream: int = 3000, downstream: int = 3000) -> DataFrame:
    """gene_id, chrom, start_pos, end_pos around the start of each gene that lies on one chromosome and strand.

    ``transcripts`` has tx_id, chrom, strand, tx_start, tx_end, ``gene_of`` gene_id and tx_id. A gene spans all its
    transcripts; its start is the lower end on the + strand and the upper on the -. Starts may fall below 1.
    """
    spans = transcripts.join(gene_of, "tx_id").groupBy("gene_id").agg(F.count_distinct("chrom", "strand").alias("places"), F.first("chrom").alias("chrom"), F.first("strand").alias("strand"), F.min("tx_start").alias("low"), F.max("tx_end").alias("high"))
    plus = F.col("strand") == "+"
    start = F.when(plus, F.col("low") - upstream).otherwise(F.col("high") - downstream + 1)
    end = F.when(plus, F.col("low") + downstream - 1).otherwise(F.col("high") + upstream)
    return spans.filter("places = 1").select("gene_id", "chrom", "strand", start.alias("start_pos"), end.alias("end_pos"))
