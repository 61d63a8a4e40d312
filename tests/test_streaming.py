from lodestrand.operators import genotypes
from lodestrand.streaming import counts


def test_batches_add_up(spark, tmp_path):
    calls = spark.createDataFrame([(i, v, (i + v) % 5 + 1) for i in range(40) for v in range(6)], "sample_idx bigint, variant_idx bigint, state int")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    calls.filter("sample_idx < 15").repartition(3).write.parquet(source)
    counts.start_counting(spark, source, out, mark, files_per_batch=2).awaitTermination()
    calls.filter("sample_idx >= 15").write.mode("append").parquet(source)
    counts.start_counting(spark, source, out, mark).awaitTermination()
    want = genotypes.allele_counts(calls, 50)
    got = counts.totals(spark, out, 50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
