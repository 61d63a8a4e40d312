import random

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import selection, skew


def test_a_key_of_one_percent_is_split_by_its_rows(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    hot = skew.hot_buckets(df, ["k"], rows_per_task=50)
    bucket = spark.range(1).select(F.lit(-1).cast("bigint").alias("k")).select(skew.key_bucket(["k"])).first()[0]
    assert hot == {bucket: 4} and skew.hot_buckets(df, ["k"]) == {}
    sizes = {r["s"]: r["count"] for r in skew.salted(df, ["k"], hot, F.col("id"), "s").filter("k = -1").groupBy("s").count().collect()}
    assert set(sizes) == {0, 1, 2, 3} and sum(sizes.values()) == 200


def test_hot_buckets_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT", 8)
    hot = skew.hot_buckets(spark.range(20_000).select((F.col("id") % 100).alias("k")), ["k"], rows_per_task=1)
    assert hot == {}
    hot = skew.hot_buckets(spark.range(20_000).select(F.least("id", F.lit(100)).alias("k")), ["k"], rows_per_task=1)
    assert list(hot.values()) == [8]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, how, monkeypatch):
    left = spark.range(3_000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    right = spark.range(0, 3_000, 2).select((F.col("id") + 1).alias("k"), F.lit("r").alias("y"))
    monkeypatch.setattr("lodestrand.operators.skew.broadcast_if_small_rows", lambda df: None)
    got = skew.skew_join(left, right, ["k"], how, rows_per_task=100)
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))


@pytest.mark.parametrize("bins", [2, 16, 256])
def test_select_ranks_against_sorting(spark, bins):
    rng = random.Random(bins)
    values = {"hot": [rng.randrange(1 << 40) for _ in range(900)] + [5] * 100, "ties": [3] * 50, "one": [9], "wide": [-(2**62), 2**62, 0]}
    rows = spark.createDataFrame([(k, v, "z") for k, vs in values.items() for v in vs] + [("hot", None, "z"), (None, 4, "z")], "k string, v bigint, rank string")
    rows = rows.repartition(3)
    asked = [(k, r) for k, vs in values.items() for r in {1, 2, len(vs) // 2, len(vs), len(vs) + 1, 0}]
    got = selection.select_ranks(rows, ["k"], "v", spark.createDataFrame([*asked, asked[0]], "k string, rank bigint"), bins).collect()
    assert {(r["k"], r["rank"]): r["value"] for r in got} == {(k, r): sorted(values[k])[r - 1] for k, r in asked if 1 <= r <= len(values[k])}
    assert all(r["n"] == len(values[r["k"]]) for r in got) and len(got) == len({(r["k"], r["rank"]) for r in got})


def test_quantiles_of_doubles_and_empty_table(spark):
    rows = spark.createDataFrame([("a", x) for x in (1.5, -2.0, 1e300, 1e-300, -1e300)], "k string, v double")
    got = {r["probability"]: r["value"] for r in selection.exact_quantiles(rows, ["k"], "v", (0.0, 0.5, 1.0)).collect()}
    assert got == {0.0: -1e300, 0.5: 1e-300, 1.0: 1e300}
    assert selection.exact_quantiles(rows.filter("false"), ["k"], "v", (0.5,)).collect() == []


def test_different_variants(spark):
    rows = [(1, 1, "A", "c", 5, "C", "G", "PASS"), (1, 1, "A", "d", 5, "C", "G", "PASS"), (1, 1, "A", "c", 5, "C", "T", "PASS"), (1, 1, "A", "c", 6, "C", "G", "FAIL"), (1, 1, "A", "c", 7, "C", "G", None), (1, 1, None, "c", 8, "C", "G", "PASS"), (1, 1, "X", "c", 8, "C", "G", "PASS")]
    df = spark.createDataFrame(rows, "run_id bigint, options_id int, hgnc_symbol string, category string, pos bigint, ref_allele string, alt_allele string, qc string")
    genes = spark.createDataFrame([("A",), ("A",), (None,)], "hgnc_symbol string")
    assert [tuple(r) for r in selection.different_variants(df, genes).collect()] == [(1, "A", 5, 5), (1, "A", 5, 5)]
