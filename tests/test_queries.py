from lodestrand.plans import compare, data_quality, genetics

FOUND = {
    "p1_found": {"run_id", "hgnc_symbol"},
    "p3_found": {"file_name", "line_no", "reason"},
    "p4_found": {"table_name", "row_key", "period_month", "status"},
    "p5_found": {"table_name", "load_id", "column_name", "finding"},
}


def test_every_sql_twin_has_a_query():
    for module in (data_quality, genetics):
        assert set(module.ORACLE) <= set(module.QUERIES)
    assert set(FOUND) <= set(data_quality.QUERIES)


def write_tables(spark, where):
    """All tables of the data-quality queries with a few rows each, repeats and nulls among them."""
    ts = "timestamp_ntz'2024-01-{:02d} 00:00:00'"
    sql = {
        "gene_reference": "select * from values ('A', '1', 1L, 9L), ('A', '1', 1L, 9L), ('B', '1', 5L, 9L) t(hgnc_symbol, chromosome_name, start_position, end_position)",
        "analysis_options": "select * from values (1, 2, cast(null as string)) t(options_id, long_mask_threshold, imputation)",
        "gene_assignments": f"select 1L run_id, 1 options_id, g hgnc_symbol, '1' chromosome_name, 'x' category, p pos, 'A' ref_allele, 'C' alt_allele, q qc, {ts.format(1)} assigned_at from values ('A', 1L, 'PASS'), ('A', 2L, 'PASS'), ('A', 2L, 'PASS'), ('A', 3L, 'PASS'), ('B', 1L, 'PASS'), ('B', 2L, 'FAIL'), (null, 3L, 'PASS') t(g, p, q)",
        "kinship_samples": f"select i sample_index, s sample_id, 1.0D diagonal, {ts.format(5)} loaded_at from values (1L, '[\"f\",\"1\"]'), (2L, '[\"f\",\"9\"]'), (3L, null), (4L, 'broken') t(i, s)",
        "kinship_edges": f"select e edge_id, a edge_rows, b edge_cols, v edge_values, {ts.format(5)} loaded_at from values (1L, 1L, 2L, 0.5D), (2L, 3L, 2L, -0.1D), (3L, 4L, 4L, 1.0D), (4L, 7L, 1L, 1.0D), (5L, 4L, 1L, double('nan')) t(e, a, b, v)",
        "fam": f"select 'f' fid, i iid, {ts.format(3)} loaded_at, cast(null as timestamp_ntz) deleted_at from values ('1'), ('1'), ('2') t(i)",
        "phenotypes": f"select r row_id, 1 load_id, 'c' cohort, {ts.format(2)} loaded_at, 'f' fid, i iid, g grip_kg, cast(null as string) sbp_mmhg, cast(null as string) hdl_mmol, cast(null as string) crp_mgl, cast(null as string) bone_t, cast(null as string) memory_z, '1' smoker, '0' asthma from values (1L, '1', 'x'), (2L, null, '5'), (2L, null, '5') t(r, i, g)",
        "covariates": f"select 1L row_id, 1 load_id, 'c' cohort, {ts.format(9)} loaded_at, 'f' fid, '2' iid, 1D age, 1D sex, 1D pc1, double('nan') pc2, 1D pc3, 1D array_batch",
        "value_dictionary": "select * from values ('phenotypes', 'grip_kg', 0D, 4D), ('covariates', 'pc2', 0D, 1D) t(table_name, column_name, min_value, max_value)",
        "raw_lines": "select * from values ('a.csv', 'csv', 1, 'FID,IID,x'), ('a.csv', 'csv', 2, 'f,1,2'), ('a.csv', 'csv', 3, 'f,1'), ('b.fam', 'fam', 1, '1 2 3') t(file_name, kind, line_no, line)",
    }
    for name, text in sql.items():
        spark.sql(text).write.parquet(f"{where}/{name}.parquet")


def test_data_quality_queries_against_sql(spark, tmp_path):
    write_tables(spark, tmp_path)
    for name, query in data_quality.QUERIES.items():
        df = query(spark, str(tmp_path))
        assert name not in FOUND or set(df.columns) == FOUND[name]
        columns, rows = compare.sql_rows(data_quality.ORACLE[name], str(tmp_path))
        assert compare.rows_of(df.columns, df.collect()) == compare.rows_of(columns, rows), name
