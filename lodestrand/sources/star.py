"""The star-schema tables seen as a genotype study: samples, variants, calls, traits and genes.

Every function has its SQL twin in ``SQL``, so both engines start from the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import sample_key
from ..session import table

# Fixed values of the projection.
CATEGORIES = ("upstream", "downstream", "UTR3", "UTR5", "UTR5;UTR3", "exonic", "splicing", "exonic;splicing", "ncRNA_exonic", "ncRNA_splicing", "ncRNA_exonic;splicing", "intergenic")
EXONIC = ("nonsynonymous SNV", "synonymous SNV", "stopgain", "stoploss", "frameshift deletion", "frameshift insertion", "")
GENE_PARTS = 20


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, fid, iid, sample_key, segment of every customer."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_idx"), F.col("c_nationkey").cast("string").alias("fid"), F.col("c_name").alias("iid"), F.col("c_mktsegment").alias("segment"))
    return customer.withColumn("sample_key", sample_key("fid", "iid"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotated variant per part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    gene = lambda step: F.concat(F.lit("G"), (F.floor(k / GENE_PARTS) + step).cast("string"))
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    info = (
        F.when(k % 4 == 0, F.concat(gene(0), F.lit(","), gene(1)))
        .when(k % 4 == 1, F.concat(gene(0), F.lit("("), F.col("p_name"), F.lit(")")))
        .when(k % 4 == 2, F.concat(gene(0), F.lit(","), gene(1), F.lit(","), gene(2), F.lit(","), gene(3), F.lit("(detail);rest")))
        .otherwise(F.concat(gene(0), F.lit("-rest")))
    )
    return table(spark, sf_dir, "part").select(
        k.alias("variant_idx"),
        F.lit("21").alias("chrom"),
        (k * 10 + 1).alias("pos"),
        F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1)).alias("ref"),
        F.when(k % 13 == 0, "TTA").otherwise(F.substring(F.lit("CGTA"), (k % 4 + 1).cast("int"), F.lit(1))).alias("alt"),
        F.when(k % 97 == 0, "FAIL").otherwise("PASS").alias("qc"),
        pick(CATEGORIES, (size * 7 + k) % len(CATEGORIES)).alias("category"),
        info.alias("info"),
        pick(EXONIC, size % len(EXONIC)).alias("exonic"),
        F.when(size % 3 == 0, "D").when(size % 3 == 1, "T").alias("metasvm"),
        F.when(k % 5 == 0, F.concat(F.lit("a=b=c="), gene(0), F.lit(";detail"))).otherwise("").alias("genehancer"),
        F.when(size % 2 == 0, "yes").otherwise("").alias("cage"),
        F.when(size % 3 == 0, "yes").otherwise("").alias("dhs"),
        F.when(k % 29 != 0, size.cast("double")).alias("cadd"),
        (F.floor(F.col("p_retailprice")) % 40).cast("double").alias("local_diversity"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, variant_idx, state of every call that is not homozygous reference."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per_pair = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("sample_idx"), F.col("l_partkey").alias("variant_idx"))
    seen = lambda number, flag: F.bool_or((F.col("l_linenumber") == number) & (F.col("l_returnflag") == flag))
    state = F.when(seen(7, "R"), 3).when(seen(7, "A"), 4).when(seen(7, "N"), 5).otherwise(F.least(F.count(F.lit(1)), F.lit(2)))
    return per_pair.agg(state.cast("int").alias("state"))


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx and the traits balance (continuous) and building (binary), null where not measured."""
    measured = F.col("c_custkey") % 53 != 0
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sample_idx"), F.when(measured, F.col("c_acctbal")).alias("balance"), F.when(measured, (F.col("c_mktsegment") == "BUILDING").cast("double")).alias("building")
    )


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, nation and n_orders, the latter null for customers without orders."""
    n_orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample_idx")).agg(F.count(F.lit(1)).cast("double").alias("n_orders"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_idx"), F.col("c_nationkey").cast("double").alias("nation")).join(n_orders, "sample_idx", "left")


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trait, sample_idx, y, x0 (intercept), x1, x2 of the complete cases of each trait."""
    rows = traits(spark, sf_dir).join(covariates(spark, sf_dir), "sample_idx")
    long = rows.unpivot(["sample_idx", "nation", "n_orders"], ["balance", "building"], "trait", "y").dropna()
    return long.select("trait", "sample_idx", "y", F.lit(1.0).alias("x0"), F.col("nation").alias("x1"), F.col("n_orders").alias("x2"))


def joint_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trait (balance, n_orders), sample_idx, y, x0, x1 (nation) of samples that have both."""
    rows = traits(spark, sf_dir).select("sample_idx", "balance").join(covariates(spark, sf_dir), "sample_idx").dropna()
    long = rows.unpivot(["sample_idx", "nation"], ["balance", "n_orders"], "trait", "y")
    return long.select("trait", "sample_idx", "y", F.lit(1.0).alias("x0"), F.col("nation").alias("x1"))


def relatives(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Relationship entries: diagonal (sample_idx, value) and edges (i, j, value) among families of up to three neighbouring customers."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_idx"))
    near = ids.select(F.col("sample_idx").alias("i"), F.explode(F.array(F.lit(1), F.lit(2))).alias("step")).filter("i div 3 = (i + step) div 3")
    return ids.withColumn("value", F.lit(1.0)), near.select("i", (F.col("i") + F.col("step")).alias("j"), F.lit(0.25).alias("value"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_name, chrom, start_pos, end_pos: twenty neighbouring parts each."""
    rows = variants(spark, sf_dir).groupBy(F.concat(F.lit("G"), F.floor(F.col("variant_idx") / GENE_PARTS).cast("string")).alias("gene_name"), "chrom")
    return rows.agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"))


def promoters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, start_pos, end_pos: thirty positions around the start of each fifth gene."""
    start = F.col("start_pos")
    return genes(spark, sf_dir).filter((start - 1) % (50 * GENE_PARTS) == 0).select("chrom", (start - 30).alias("start_pos"), (start + 30).alias("end_pos"))


def raw_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, a1, a2, score as an annotation file gives them: either allele order, text scores, some variants absent."""
    k = F.col("variant_idx")
    swapped = k % 3 == 0
    score = F.when(k % 11 == 0, ".").when(k % 11 == 1, "NA").when(k % 11 == 2, "").otherwise(F.format_string("%d.5", k % 40))
    return variants(spark, sf_dir).filter(k % 17 != 0).select("pos", F.when(swapped, F.col("alt")).otherwise(F.col("ref")).alias("a1"), F.when(swapped, F.col("ref")).otherwise(F.col("alt")).alias("a2"), score.alias("score"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _g(step: int) -> str:
    return f"'G' || (p_partkey // {GENE_PARTS} + {step})"


#: The same tables as common table expressions, to follow WITH.
SQL = f"""
    samples AS (
      SELECT c_custkey sample_idx, c_nationkey::VARCHAR fid, c_name iid, c_mktsegment segment, '["' || c_nationkey || '","' || c_name || '"]' sample_key FROM customer),
    variants AS (
      SELECT p_partkey variant_idx, '21' chrom, p_partkey * 10 + 1 pos, substr('ACGT', p_partkey % 4 + 1, 1) AS ref,
        CASE WHEN p_partkey % 13 = 0 THEN 'TTA' ELSE substr('CGTA', p_partkey % 4 + 1, 1) END alt,
        CASE WHEN p_partkey % 97 = 0 THEN 'FAIL' ELSE 'PASS' END qc,
        ({_list(CATEGORIES)})[(p_size * 7 + p_partkey) % {len(CATEGORIES)} + 1] category,
        CASE p_partkey % 4 WHEN 0 THEN {_g(0)} || ',' || {_g(1)} WHEN 1 THEN {_g(0)} || '(' || p_name || ')'
          WHEN 2 THEN {_g(0)} || ',' || {_g(1)} || ',' || {_g(2)} || ',' || {_g(3)} || '(detail);rest' ELSE {_g(0)} || '-rest' END info,
        ({_list(EXONIC)})[p_size % {len(EXONIC)} + 1] exonic,
        CASE p_size % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'T' END metasvm,
        CASE WHEN p_partkey % 5 = 0 THEN 'a=b=c=' || {_g(0)} || ';detail' ELSE '' END genehancer,
        CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE '' END cage, CASE WHEN p_size % 3 = 0 THEN 'yes' ELSE '' END dhs,
        CASE WHEN p_partkey % 29 <> 0 THEN p_size::DOUBLE END cadd, (floor(p_retailprice)::BIGINT % 40)::DOUBLE local_diversity
      FROM part),
    calls AS (
      SELECT o_custkey sample_idx, l_partkey variant_idx,
        CASE WHEN bool_or(l_linenumber = 7 AND l_returnflag = 'R') THEN 3 WHEN bool_or(l_linenumber = 7 AND l_returnflag = 'A') THEN 4
             WHEN bool_or(l_linenumber = 7 AND l_returnflag = 'N') THEN 5 ELSE least(count(*), 2) END::INT state
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey),
    traits AS (
      SELECT c_custkey sample_idx, CASE WHEN c_custkey % 53 <> 0 THEN c_acctbal END balance, CASE WHEN c_custkey % 53 <> 0 THEN (c_mktsegment = 'BUILDING')::INT::DOUBLE END building FROM customer),
    covariates_of AS (
      SELECT c_custkey sample_idx, c_nationkey::DOUBLE nation, n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey),
    design AS (
      SELECT trait, sample_idx, y, 1.0::DOUBLE x0, nation x1, n_orders x2
      FROM (SELECT sample_idx, 'balance' trait, balance y FROM traits UNION ALL SELECT sample_idx, 'building', building FROM traits) JOIN covariates_of USING (sample_idx)
      WHERE y IS NOT NULL AND n_orders IS NOT NULL),
    genes AS (SELECT 'G' || (variant_idx // {GENE_PARTS}) gene_name, chrom, min(pos) start_pos, max(pos) end_pos FROM variants GROUP BY 1, 2),
    promoters AS (SELECT chrom, start_pos - 30 start_pos, start_pos + 30 end_pos FROM genes WHERE (start_pos - 1) % {50 * GENE_PARTS} = 0),
    raw_annotations AS (
      SELECT pos, CASE WHEN variant_idx % 3 = 0 THEN alt ELSE ref END a1, CASE WHEN variant_idx % 3 = 0 THEN ref ELSE alt END a2,
        CASE variant_idx % 11 WHEN 0 THEN '.' WHEN 1 THEN 'NA' WHEN 2 THEN '' ELSE (variant_idx % 40) || '.5' END score
      FROM variants WHERE variant_idx % 17 <> 0)"""
