"""Queries p1 and p3 to p5 and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import orphans, profile, rejects, selection
from ..session import stored, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and genes whose variant of rank threshold + 1 exists, found by exact selection; variants rank by a key without nulls."""
    assignments = table(spark, sf_dir, "gene_assignments")
    variants = stored(selection.different_variants(assignments, table(spark, sf_dir, "gene_reference")), "variants")
    limits = table(spark, sf_dir, "analysis_options").select("options_id", "long_mask_threshold").distinct()
    runs = assignments.groupBy("run_id").agg(F.min("options_id").alias("options_id")).join(limits, "options_id")
    genes = variants.select("run_id", "hgnc_symbol").distinct()
    wanted = genes.join(runs, "run_id").select("run_id", "hgnc_symbol", (F.col("long_mask_threshold") + 1).alias("rank"))
    return selection.select_ranks(variants, ["run_id", "hgnc_symbol"], "variant", wanted).select("run_id", "hgnc_symbol")


def p1_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles of the positions of each run's and gene's different passing variants."""
    variants = stored(selection.different_variants(table(spark, sf_dir, "gene_assignments"), table(spark, sf_dir, "gene_reference")), "variants")
    return selection.exact_quantiles(variants, ["run_id", "hgnc_symbol"], "pos", (0.25, 0.5, 0.75))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = rejects.split_lines(table(spark, sf_dir, "raw_lines"))
    return rejected.select("file_name", "line_no", "reason")


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, values and missing values that each file yields once its failing lines are set apart."""
    loaded, _ = rejects.split_lines(table(spark, sf_dir, "raw_lines"))
    present = F.size(F.filter("values", lambda v: v.isNotNull()))
    return loaded.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(present).alias("n_values"), F.sum(F.size("values") - present).alias("n_missing"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "kinship_samples")
    references = orphans.person_references(table(spark, sf_dir, "phenotypes"), table(spark, sf_dir, "covariates"), samples)
    people = orphans.individual_orphans(references, orphans.validity_runs(table(spark, sf_dir, "fam")))
    return people.unionByName(orphans.edge_orphans(table(spark, sf_dir, "kinship_edges"), samples))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, month and status."""
    return _orphans(spark, sf_dir).groupBy("table_name", "period_month", "status").agg(F.count(F.lit(1)).alias("n_orphans"))


def _loads(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    return {t: table(spark, sf_dir, t) for t in ("phenotypes", "covariates")}, table(spark, sf_dir, "value_dictionary")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.findings(*_loads(spark, sf_dir))


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole profile; rates and distances rounded to nine places."""
    full = profile.profile(*_loads(spark, sf_dir))
    rate = F.round(F.col("missing") / F.col("rows"), 9)
    return full.select("table_name", "load_id", "column_name", F.col("rows").alias("n_rows"), rate.alias("null_rate"), F.col("bad").alias("n_bad"), F.col("distinct").alias("n_distinct"), "least", "greatest", "q25", "q50", "q75", F.round("distance", 9).alias("distance"))


QUERIES = {f.__name__: f for f in (p1_found, p1_quantiles, p3_found, p3_loaded, p4_found, p4_report, p5_found, p5_profile)}

_VARIANTS = """
    SELECT DISTINCT a.run_id, a.hgnc_symbol, a.pos, a.ref_allele, a.alt_allele
    FROM gene_assignments a WHERE a.qc = 'PASS' AND a.hgnc_symbol IN (SELECT hgnc_symbol FROM gene_reference)"""

_PEOPLE = """
    SELECT DISTINCT table_name, row_key, fid, iid, loaded_at t FROM (
      SELECT 'phenotypes' table_name, row_id row_key, fid, iid, loaded_at FROM phenotypes
      UNION ALL SELECT 'covariates', row_id, fid, iid, loaded_at FROM covariates
      UNION ALL SELECT 'kinship_samples', sample_index, CASE WHEN json_valid(sample_id) THEN json_extract_string(sample_id, '$[0]') END, CASE WHEN json_valid(sample_id) THEN json_extract_string(sample_id, '$[1]') END, loaded_at FROM kinship_samples)
    WHERE fid IS NOT NULL AND iid IS NOT NULL"""

_ORPHANS = f"""
    WITH people AS ({_PEOPLE}),
    judged AS (
      SELECT p.table_name, p.row_key, p.fid, p.iid, p.t, count(f.fid) n, count(*) FILTER (f.loaded_at <= p.t) n_before,
             count(*) FILTER (f.loaded_at <= p.t AND (f.deleted_at IS NULL OR f.deleted_at > p.t)) n_valid
      FROM people p LEFT JOIN (SELECT DISTINCT fid, iid, loaded_at, deleted_at FROM fam) f ON p.fid = f.fid AND p.iid = f.iid GROUP BY ALL)
    SELECT DISTINCT table_name, row_key, strftime(t, '%Y-%m') period_month,
           CASE WHEN n = 0 THEN 'missing' WHEN n_before = 0 THEN 'late' ELSE 'deleted' END status
    FROM judged WHERE n_valid = 0
    UNION
    SELECT DISTINCT 'kinship_edges', edge_id, strftime(loaded_at, '%Y-%m'), 'missing' FROM kinship_edges
    WHERE (edge_rows IS NOT NULL AND edge_rows NOT IN (SELECT sample_index FROM kinship_samples WHERE sample_index IS NOT NULL))
       OR (edge_cols IS NOT NULL AND edge_cols NOT IN (SELECT sample_index FROM kinship_samples WHERE sample_index IS NOT NULL))"""

_PHENOTYPES = ("grip_kg", "sbp_mmhg", "hdl_mmol", "crp_mgl", "bone_t", "memory_z", "smoker", "asthma")
_COVARIATES = ("age", "sex", "pc1", "pc2", "pc3", "array_batch")
_STRIP = r"'^[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$'"

_CELLS = f"""
    WITH long AS (
      SELECT 'phenotypes' table_name, cohort, load_id, column_name, regexp_replace(raw, {_STRIP}, '', 'g') raw, NULL::DOUBLE dbl FROM (
        {' UNION ALL '.join(f"SELECT cohort, load_id, '{c}' column_name, {c} raw FROM (SELECT DISTINCT * FROM phenotypes)" for c in _PHENOTYPES)})
      UNION ALL
      {' UNION ALL '.join(f"SELECT 'covariates', cohort, load_id, '{c}', NULL, {c} FROM (SELECT DISTINCT * FROM covariates)" for c in _COVARIATES)}),
    parsed AS (
      SELECT table_name, cohort, load_id, column_name,
        CASE WHEN table_name = 'covariates' THEN dbl IS NULL OR isnan(dbl) ELSE raw IS NULL OR lower(raw) IN ('', 'na', 'nan', 'null', 'none', 'n/a') END missing,
        CASE WHEN table_name = 'covariates' THEN CASE WHEN isfinite(dbl) THEN dbl + 0.0 END
             WHEN regexp_full_match(raw, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(TRY_CAST(raw AS DOUBLE)) THEN TRY_CAST(raw AS DOUBLE) + 0.0 END val
      FROM long),
    cells AS (
      SELECT table_name, cohort, load_id, column_name, count(*) n_rows, count(*) FILTER (missing) n_missing, count(*) FILTER (NOT missing AND val IS NULL) n_bad,
             count(val) n_numbers, count(DISTINCT val) n_distinct, min(val) least, max(val) greatest,
             quantile_disc(val, 0.25) q25, quantile_disc(val, 0.5) q50, quantile_disc(val, 0.75) q75
      FROM parsed GROUP BY ALL),
    chained AS (
      SELECT *, lag(load_id) OVER w p_load, lag(n_rows) OVER w p_rows, lag(n_missing) OVER w p_missing, lag(n_distinct) OVER w p_distinct, lag(n_numbers) OVER w p_numbers
      FROM cells WINDOW w AS (PARTITION BY table_name, cohort, column_name ORDER BY load_id)),
    points AS (
      SELECT c.table_name, c.load_id, c.column_name, p.val, c.n_numbers, c.p_numbers, (p.load_id = c.load_id)::INT cur, (p.load_id = c.p_load)::INT prev
      FROM chained c JOIN parsed p ON p.table_name = c.table_name AND p.cohort = c.cohort AND p.column_name = c.column_name AND p.load_id IN (c.load_id, c.p_load)
      WHERE p.val IS NOT NULL AND c.n_numbers > 0 AND c.p_numbers > 0),
    curves AS (
      SELECT table_name, load_id, column_name, n_numbers, p_numbers, sum(cur) OVER w cur, sum(prev) OVER w prev
      FROM points WINDOW w AS (PARTITION BY table_name, load_id, column_name ORDER BY val)),
    shifts AS (
      SELECT table_name, load_id, column_name, max(abs(cur / n_numbers - prev / p_numbers)) distance FROM curves GROUP BY ALL)"""

_BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_FIELD = '"(?:[^"]|"")*"|[^",]*'
_LINES = rf"""
    WITH lines AS (SELECT DISTINCT file_name, kind, line_no, line FROM raw_lines),
    csv AS (
      SELECT file_name, line_no, line, regexp_full_match(line, '(?:{_FIELD})(?:,(?:{_FIELD}))*', 's') quoted,
        [CASE WHEN f LIKE '"%' THEN replace(f[2:-2], '""', '"') ELSE f END FOR f IN regexp_extract_all(',' || line, ',({_FIELD})', 1, 's')] fields
      FROM (SELECT file_name, line_no, CASE WHEN line_no = 1 THEN regexp_replace(line, '^\x{{feff}}', '') ELSE line END line FROM lines WHERE kind = 'csv')),
    fam AS (
      SELECT file_name, line_no, CASE WHEN regexp_full_match(line, '[ \t]*') THEN [] ELSE regexp_split_to_array(regexp_replace(line, '^[ \t]+|[ \t]+$', '', 'g'), '[ \t]+') END fields
      FROM lines WHERE kind = 'fam'),
    judged AS (
      SELECT file_name, line_no, fields, [regexp_replace(f, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') FOR f IN fields[3:]] texts,
        CASE WHEN NOT quoted THEN 'quoting' WHEN len(fields) <> width THEN 'column_count'
             WHEN fields[1] = '' OR fields[2] = '' OR regexp_matches(fields[1], '[\pZ\pC]') OR regexp_matches(fields[2], '[\pZ\pC]') THEN 'identifier'
             WHEN len([t FOR t IN texts IF lower(t) NOT IN ('', 'na', 'nan', 'null', 'none', 'n/a')
                       AND NOT (regexp_full_match(t, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(isfinite(TRY_CAST(t AS DOUBLE)), false))]) > 0 THEN 'value' END reason
      FROM csv JOIN (SELECT file_name, len(fields) width FROM csv WHERE line_no = 1) USING (file_name)
      WHERE line_no > 1 AND (NOT quoted OR len([f FOR f IN fields IF regexp_matches(f, '[^{_BLANK}]')]) > 0)
      UNION ALL
      SELECT file_name, line_no, fields, [], CASE WHEN len(fields) <> 6 THEN 'column_count'
             WHEN regexp_matches(fields[1], '[\pZ\pC]') OR regexp_matches(fields[2], '[\pZ\pC]') THEN 'identifier' END FROM fam)"""

ORACLE = {
    "p3_found": f"{_LINES} SELECT file_name, line_no, reason FROM judged WHERE reason IS NOT NULL",
    "p3_loaded": f"""{_LINES}
        SELECT file_name, count(*) AS n_rows, sum(len(texts) - missing)::BIGINT AS n_values, sum(missing)::BIGINT AS n_missing FROM (
          SELECT *, len([t FOR t IN texts IF lower(t) IN ('', 'na', 'nan', 'null', 'none', 'n/a')]) missing FROM judged WHERE reason IS NULL)
        GROUP BY file_name""",
    "p1_found": f"""
        SELECT v.run_id, v.hgnc_symbol FROM ({_VARIANTS}) v
        JOIN (SELECT DISTINCT run_id, options_id FROM gene_assignments) r ON r.run_id = v.run_id
        JOIN (SELECT DISTINCT * FROM analysis_options) o ON o.options_id = r.options_id
        GROUP BY v.run_id, v.hgnc_symbol, o.long_mask_threshold HAVING count(*) > o.long_mask_threshold""",
    "p1_quantiles": f"""
        SELECT run_id, hgnc_symbol, probability, n, min(pos) AS value FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id, hgnc_symbol ORDER BY pos) rn, count(*) OVER (PARTITION BY run_id, hgnc_symbol) n FROM ({_VARIANTS})),
          (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) q(probability)
        WHERE rn >= probability * n GROUP BY run_id, hgnc_symbol, probability, n""",
    "p4_found": _ORPHANS,
    "p4_report": f"SELECT table_name, period_month, status, count(*) AS n_orphans FROM ({_ORPHANS}) GROUP BY ALL",
    "p5_found": f"""{_CELLS}
        SELECT DISTINCT table_name, load_id, column_name, finding FROM (
          SELECT c.table_name, c.load_id, c.column_name, unnest([
            CASE WHEN n_bad > 0 THEN 'pattern' END, CASE WHEN least < min_value OR greatest > max_value THEN 'range' END,
            CASE WHEN n_distinct = 1 THEN 'constant' END, CASE WHEN n_distinct < 0.5 * p_distinct THEN 'distinct' END,
            CASE WHEN abs(n_missing / n_rows - p_missing / p_rows) > 0.15 THEN 'null_rate' END, CASE WHEN distance > 0.3 THEN 'shift' END]) finding
          FROM chained c JOIN (SELECT DISTINCT * FROM value_dictionary) d ON d.table_name = c.table_name AND d.column_name = c.column_name
          LEFT JOIN shifts s ON s.table_name = c.table_name AND s.load_id = c.load_id AND s.column_name = c.column_name)
        WHERE finding IS NOT NULL""",
    "p5_profile": f"""{_CELLS}
        SELECT c.table_name, c.load_id, c.column_name, n_rows, round(n_missing / n_rows, 9) null_rate, n_bad, n_distinct, least, greatest, q25, q50, q75, round(distance, 9) distance
        FROM chained c LEFT JOIN shifts s ON s.table_name = c.table_name AND s.load_id = c.load_id AND s.column_name = c.column_name
        WHERE (c.table_name, c.column_name) IN (SELECT (table_name, column_name) FROM value_dictionary)""",
}
