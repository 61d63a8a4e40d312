"""Queries p2 and p6 to p8, and the SQL twins of those that have one (tokens and learned labels have none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, table
from . import components, encode, packing, subjects


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = components.kinship_links(table(spark, sf_dir, "kinship_edges"), table(spark, sf_dir, "kinship_samples"))
    groups = components.connected_components(links)
    return groups.select(F.col("vertex").alias("sample_index"), F.col("group").alias("group_index"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stored(encode.token_counts(table(spark, sf_dir, "documents")), "sizes")
    return packing.pack(sizes, table(spark, sf_dir, "container_specs"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of every document, for each kind of container."""
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and the share of their capacity that is filled."""
    return packing.fill(_packed(spark, sf_dir), table(spark, sf_dir, "container_specs"))


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that each kind of container holds whole, and every breach of the rules of packing."""
    specs = table(spark, sf_dir, "container_specs")
    return packing.audit(stored(_packed(spark, sf_dir), "packed"), specs)


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], float]:
    return subjects.subject_posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, names, threshold = _scored(spark, sf_dir)
    return subjects.assign(scored.filter("mask is null"), names, threshold).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and expected documents of each subject, and their share of the corpus."""
    scored, names, threshold = _scored(spark, sf_dir)
    scored = stored(scored, "scored")
    every = scored.count()
    per_subject = subjects.assign(scored, names, 0.0).groupBy("subject")
    return per_subject.agg(
        F.count_if(F.col("posterior") > threshold).alias("n_documents"), F.round(F.sum("posterior"), 1).alias("n_expected"), F.round(F.sum("posterior") / F.lit(max(every, 1)), 4).alias("share")
    )


def p8_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors of the labelled documents, by weights without their own words, beside the share that has the label."""
    features, model, _ = subjects.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))
    return subjects.reliability(features, model).select("bin", "n_pairs", F.round("mean_posterior", 4).alias("mean_posterior"), F.round("share_labelled", 4).alias("share_labelled"))


QUERIES = {f.__name__: f for f in (p2_found, p6_ids, p7_containers, p7_fill, p7_audit, p8_found, p8_composition, p8_reliability)}
_LINKS = """
    SELECT edge_rows u, edge_cols v FROM kinship_edges
    WHERE edge_rows <> edge_cols AND edge_values IS NOT NULL AND NOT isnan(edge_values) AND NOT isinf(edge_values) AND edge_values <> 0
      AND edge_rows IN (SELECT sample_index FROM kinship_samples) AND edge_cols IN (SELECT sample_index FROM kinship_samples)"""

ORACLE = {
    "p2_found": f"""
        WITH RECURSIVE links AS (SELECT u, v FROM ({_LINKS}) UNION SELECT v, u FROM ({_LINKS})),
        reach(a, b) AS (SELECT u, u FROM links UNION SELECT r.a, l.v FROM reach r JOIN links l ON l.u = r.b)
        SELECT a AS sample_index, min(b) AS group_index FROM reach GROUP BY a""",
    "p7_audit": """
        SELECT container_name, (SELECT count(*) FROM documents WHERE text <> '') AS n_whole, 0::BIGINT AS n_broken, 0::BIGINT AS n_split, 0::BIGINT AS n_overfull, 0::BIGINT AS n_gappy
        FROM (SELECT DISTINCT container_name FROM container_specs)""",
}
