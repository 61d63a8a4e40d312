import math
import random

import pytest

from lodestrand.operators import profile


def ks(a, b):
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in [*a, *b])


def make(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for cohort, loads in (("c1", (1, 2, 5)), (None, (7, 9))):
        for load in loads:
            for _ in range(120):
                n += 1
                text = rng.choice(["1", "1.0", " 2 ", "+3e0", "NA", "", None, "x1", "1e999", str(rng.gauss(load, 1))])
                rows.append((n, load, cohort, text, rng.choice([0.0, -0.0, math.nan, math.inf, None, rng.gauss(0, load)]), "extra"))
    rows += rows[:7] + [(99_999, None, "c1", "1", 1.0, "extra")]
    df = spark.createDataFrame(rows, "row_id bigint, load_id int, cohort string, t string, d double, part string")
    limits = spark.createDataFrame([("x", "t", -3.0, 3.0), ("x", "d", -1e9, 1e9), ("x", "absent", 0.0, 1.0)], "table_name string, column_name string, min_value double, max_value double")
    return sorted(set(map(repr, rows))), rows, df, limits


def test_profile_against_brute_force(spark):
    _, rows, df, limits = make(spark)
    got = {(r["load_id"], r["column_name"]): r for r in profile.profile({"x": df}, limits, (0.25, 0.5)).collect()}
    assert len(got) == 10
    unique = {r[0]: r for r in rows if r[1] is not None}.values()
    numbers = {}
    for (load, column), cell in got.items():
        raw = [r[3] if column == "t" else r[4] for r in unique if r[1] == load]
        values, missing, bad = [], 0, 0
        for x in raw:
            if x is None or (isinstance(x, str) and x.strip().lower() in ("", "na")) or x != x:
                missing += 1
            elif (isinstance(x, str) and x == "x1") or not math.isfinite(float(x)):
                bad += 1
            else:
                values.append(float(x) + 0.0)
        values.sort()
        numbers[load, column] = values
        assert (cell["rows"], cell["missing"], cell["bad"], cell["numbers"], cell["distinct"]) == (len(raw), missing, bad, len(values), len(set(values)))
        assert (cell["least"], cell["greatest"], cell["q25"], cell["q50"]) == (values[0], values[-1], values[math.ceil(len(values) / 4) - 1], values[math.ceil(len(values) / 2) - 1])
    for (load, column), before in {(2, "t"): 1, (5, "t"): 2, (9, "t"): 7, (5, "d"): 2}.items():
        assert math.isclose(got[load, column]["distance"], ks(numbers[load, column], numbers[before, column]), abs_tol=1e-12)
    assert got[1, "t"]["distance"] is None and got[7, "d"]["distance"] is None


def test_findings_and_empty_table(spark):
    _, _, df, limits = make(spark)
    found = {(r["load_id"], r["column_name"], r["finding"]) for r in profile.findings({"x": df}, limits).collect()}
    assert {(l, "t", "pattern") for l in (1, 2, 5, 7, 9)} <= found and (9, "t", "range") in found
    assert profile.findings({"x": df.filter("false")}, limits).collect() == []


def test_each_change_of_a_load(spark):
    loads = {1: [float(x) for x in range(20)], 2: [x + 10.0 for x in range(20)], 3: [5.0] * 20, 4: [5.0] * 16 + [None] * 4, 5: [None] * 20, 6: [1.0, 2.0] * 10}
    rows = [(load * 100 + i, load, "c", x) for load, xs in loads.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "row_id bigint, load_id int, cohort string, v double")
    limits = spark.createDataFrame([("x", "v", 0.0, 25.0)], "table_name string, column_name string, min_value double, max_value double")
    found = {}
    for r in profile.findings({"x": df}, limits).collect():
        found.setdefault(r["load_id"], set()).add(r["finding"])
    assert found == {2: {"range", "shift"}, 3: {"constant", "distinct", "shift"}, 4: {"constant", "null_rate"}, 5: {"distinct", "null_rate"}, 6: {"null_rate"}}


def test_null_and_empty_cohorts_are_one(spark):
    rows = [(1, 1, None, 5.0), (2, 1, "", 5.0), (3, 1, "", 5.0), (3, 1, "", 5.0)]
    df = spark.createDataFrame(rows, "row_id bigint, load_id int, cohort string, v double")
    limits = spark.createDataFrame([("x", "v", 0.0, 9.0)], "table_name string, column_name string, min_value double, max_value double")
    (cell,) = profile.profile({"x": df}, limits).collect()
    assert (cell["rows"], cell["numbers"], cell["distinct"]) == (3, 3, 1)
    assert [r["finding"] for r in profile.findings({"x": df}, limits).collect()] == ["constant"]


@pytest.mark.parametrize("partitions", [1, 12, 200])
def test_equal_values_of_loads_stay_in_one_partition(spark, partitions):
    rows = [(load * 100 + i, load, "c", float(i % 2), 7.0) for load in range(1, 16) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id bigint, load_id int, cohort string, v double, same double")
    limits = spark.createDataFrame([("x", "v", 0.0, 1.0), ("x", "same", 0.0, 9.0)], "table_name string, column_name string, min_value double, max_value double")
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        distances = {(r["load_id"], r["column_name"]): r["distance"] for r in profile.profile({"x": df}, limits).collect()}
        found = {(r["column_name"], r["finding"]) for r in profile.findings({"x": df}, limits).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(d == (None if load == 1 else 0.0) for (load, _), d in distances.items()) and len(distances) == 30
    assert found == {("same", "constant")}
