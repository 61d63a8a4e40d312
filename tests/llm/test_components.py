import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import components, queries
from lodestrand.plans import compare


def brute(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def shapes():
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(200)]
    down = [(900 - i, 899 - i) for i in range(150)]
    star = [(5_000, 2_000 + i) for i in range(300)]
    noise = [(rng.randrange(10_000, 10_400), rng.randrange(10_000, 10_400)) for _ in range(260)]
    edges = chain + down + star + [e for e in noise if e[0] != e[1]] + chain[:20]
    rng.shuffle(edges)
    return edges


@pytest.mark.parametrize("partition_edges", [7, 37, 100_000])
def test_components_against_brute_force(spark, partition_edges):
    edges = shapes()
    df = spark.createDataFrame([(a, b, "x") for a, b in edges] + [(1, 1, "loop"), (None, 3, "x"), (77_777, None, "x"), (88_888, 88_888, "loop")], "u bigint, v bigint, vertex string")
    got = [tuple(r) for r in components.connected_components(df, partition_edges=partition_edges).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute(edges)


def test_empty_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_union_find_kernel():
    u, v = np.array([3, 9, 4]), np.array([9, 7, 5])
    names, roots = components.union_find(u, v, -u, -v)
    assert dict(zip(names.tolist(), roots.tolist(), strict=True)) == {3: 9, 9: 9, 7: 9, 4: 5, 5: 5}


def test_levels_of_a_long_chain_shrink(spark, monkeypatch):
    """Many partitions merge level by level; an ascending chain takes few of them."""
    counts = []
    links = components._links
    monkeypatch.setattr(components, "_links", lambda pairs: (counts.append(1), links(pairs))[1])
    chain = spark.range(4_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    groups = components.connected_components(chain, partition_edges=100)
    assert groups.count() == 4_001 and groups.select("group").distinct().collect()[0][0] == 0
    assert 3 <= len(counts) <= 8


def write_tables(spark, where):
    ts = "timestamp_ntz'2024-01-05 00:00:00'"
    spark.sql(f"select i sample_index, s sample_id, 1.0D diagonal, {ts} loaded_at from values (1L, '[\"f\",\"1\"]'), (2L, '[\"f\",\"9\"]'), (3L, null), (4L, 'broken') t(i, s)").write.parquet(f"{where}/kinship_samples.parquet")
    spark.sql(f"select e edge_id, a edge_rows, b edge_cols, v edge_values, {ts} loaded_at from values (1L, 1L, 2L, 0.5D), (2L, 3L, 2L, -0.1D), (3L, 4L, 4L, 1.0D), (4L, 7L, 1L, 1.0D), (5L, 4L, 1L, double('nan')) t(e, a, b, v)").write.parquet(f"{where}/kinship_edges.parquet")


def test_query_against_sql(spark, tmp_path):
    write_tables(spark, tmp_path)
    df = queries.p2_found(spark, str(tmp_path))
    columns, rows = compare.sql_rows(queries.ORACLE["p2_found"], str(tmp_path))
    assert set(df.columns) == {"sample_index", "group_index"}
    assert compare.rows_of(df.columns, df.collect()) == compare.rows_of(columns, rows)


def test_kinship_links(spark):
    samples = spark.createDataFrame([(1, None), (2, "x"), (2, "x"), (3, "y"), (None, "z")], "sample_index bigint, sample_id string")
    rows = [(1, 2, 0.5), (2, 1, -0.1), (1, 3, float("nan")), (1, 3, float("inf")), (2, 3, 0.0), (2, 3, None), (3, 3, 1.0), (1, 9, 1.0), (None, 1, 1.0)]
    edges = spark.createDataFrame(rows, "edge_rows bigint, edge_cols bigint, edge_values double")
    assert sorted(map(tuple, components.kinship_links(edges, samples).collect())) == [(1, 2), (2, 1)]
