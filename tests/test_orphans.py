import datetime as dt
import random

import pytest

from lodestrand.operators import orphans

FAM = "fid string, iid string, loaded_at timestamp, deleted_at timestamp, run_end string"
REFS = "table_name string, row_key bigint, fid string, iid string, loaded_at timestamp, salt string"


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("rows_per_task", [3, 100_000])
def test_individuals_against_brute_force(spark, rows_per_task):
    rng = random.Random(1)
    fam = [(rng.choice("01"), rng.choice("abc"), rng.randrange(20), rng.choice([None, *range(25)])) for _ in range(12)]
    fam += [fam[0], ("never", "x", None, None), (None, "a", 1, None)]
    refs = [(i, rng.choice(["0", "1", "never", "none"]), rng.choice("abcx"), rng.choice([None, *range(30)])) for i in range(400)] + [(9_999, None, "a", 3), (9_998, "0", None, 3)]
    refs += [(20_000 + i, "0", "a", i % 28) for i in range(300)]
    got = orphans.individual_orphans(
        spark.createDataFrame([("t", k, f, i, day(t), "x") for k, f, i, t in [*refs, refs[0]]], REFS),
        orphans.validity_runs(spark.createDataFrame([(f, i, day(a), day(b), "x") for f, i, a, b in fam], FAM)),
        rows_per_task,
    ).collect()
    want = {}
    for key, f, i, t in refs:
        own = [x for x in fam if x[:2] == (f, i) and f is not None and i is not None]
        if f is None or i is None:
            continue
        if not own:
            want[key] = "missing"
        elif t is not None and not any(a is not None and a <= t and (b is None or b > t) for _, _, a, b in own):
            want[key] = "late" if all(a is None or a > t for _, _, a, b in own) else "deleted"
    assert {r["row_key"]: r["status"] for r in got} == want and len(got) == len(want)


def test_runs_and_keys_beyond(spark):
    keys = [*range(10, 20), 65_535, 65_536, 65_537, -5, -4, None, 12]
    runs = orphans.key_runs(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k")
    assert sorted((r["run_start"], r["run_end"]) for r in runs.collect()) == [(-5, -4), (10, 19), (65_535, 65_535), (65_536, 65_537)]
    asked = [9, 10, 19, 20, 65_534, 65_536, 70_000, -6, -4, 2**40, None]
    beyond = orphans.keys_beyond_runs(spark.createDataFrame([(k, "x") for k in asked], "k bigint, run_end string"), "k", runs)
    assert sorted(r["k"] for r in beyond.collect()) == [-6, 9, 20, 65_534, 70_000, 2**40]
    assert orphans.key_runs(runs.select("block").filter("false"), "block").collect() == []
