import math

from pyspark.sql import functions as F

from lodestrand.functions import numerics, tails


def test_erfc_and_its_logarithm(spark):
    points = [0.0, 1e-12, 0.1, 0.46875, 0.46876, 1.0, 3.99, 4.0, 4.01, 10.0, 26.0, -0.2, -1.5, -7.0, None]
    rows = spark.createDataFrame([(x,) for x in points], "x double").select("x", tails.erfc(F.col("x")).alias("p")).collect()
    for r in rows:
        assert r["p"] is None if r["x"] is None else math.isclose(r["p"], math.erfc(r["x"]), rel_tol=2e-14)
    far = [0.0, 0.3, 2.0, 5.0, 30.0, 1e3, 1e8]
    for r in spark.createDataFrame([(x,) for x in far], "x double").select("x", tails.log_erfc(F.col("x")).alias("p")).collect():
        want = math.log(2) + float(numerics.log_ndtr(-r["x"] * math.sqrt(2)))
        assert math.isclose(r["p"], want, rel_tol=1e-12, abs_tol=1e-14)


def test_chi_square_tails(spark):
    for df in (1, 2, 3, 6, 7):
        rows = spark.createDataFrame([(x,) for x in (0.0, 1e-3, 0.2, 1.0, 9.0, 300.0, 5_000.0)], "half double").select("half", tails.log_chi2_sf(F.col("half"), df).alias("p")).collect()
        for r in rows:
            want = numerics.chi2_sf(2 * r["half"], df)
            if want > 1e-290:
                assert math.isclose(r["p"], math.log(want), rel_tol=1e-11, abs_tol=1e-13), (df, r)
            else:
                assert r["p"] < -600
