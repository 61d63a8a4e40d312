import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import association, kinship, set_tests

N = 90


@pytest.fixture(scope="module")
def families(spark):
    rng = np.random.default_rng(5)
    k = np.eye(N)
    for f in range(0, 60, 3):
        k[f : f + 3, f : f + 3] = 0.5 + 0.5 * np.eye(3)
    k += np.diag(rng.uniform(-0.01, 0.01, N))
    x = np.column_stack([np.ones(N), rng.standard_normal(N)])
    y = x @ [1.0, 0.5] + np.linalg.cholesky(2 * k + 0.5 * np.eye(N)) @ rng.standard_normal(N)
    b = (rng.random(N) < 1 / (1 + np.exp(-(x @ [0.2, 0.4] + np.linalg.cholesky(1.5 * k) @ rng.standard_normal(N))))).astype(float)
    make = lambda t, v: spark.createDataFrame([(t, i, float(v[i]), *map(float, x[i])) for i in range(N)], "trait string, sample_idx bigint, y double, x0 double, x1 double")
    diagonal = spark.createDataFrame([(i, float(k[i, i])) for i in range(N)], "sample_idx bigint, value double")
    edges = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(N) for j in range(N) if i != j and k[i, j]] + [(5, 5, 9.0)], "i bigint, j bigint, value double")
    return {"k": k, "x": x, "y": y, "b": b, "design": make("y", y), "binary": make("b", b), "diagonal": diagonal, "edges": edges}


def reml(tau, k, x, y):
    v = tau[0] * np.eye(len(y)) + tau[1] * k
    inverse = np.linalg.inv(v)
    xvx = x.T @ inverse @ x
    p = inverse - inverse @ x @ np.linalg.inv(xvx) @ x.T @ inverse
    return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + y @ p @ y), p


def test_linear_mixed_model_maximises_restricted_likelihood(spark, families, monkeypatch):
    monkeypatch.setattr(kinship, "BUCKET_SAMPLES", 25)
    null = kinship.fit_mixed_linear(families["design"], families["diagonal"], families["edges"], 2)
    model = null.models.first()
    tau = np.array(model["tau"])
    best, p = reml(tau, families["k"], families["x"], families["y"])
    for change in ([1e-2, 0], [-1e-2, 0], [0, 1e-2], [0, -1e-2]):
        if (tau + change >= 0).all():
            assert reml(tau + change, families["k"], families["x"], families["y"])[0] <= best + 1e-7
    rows = null.samples.orderBy("sample_idx").toPandas()
    assert np.allclose(rows["resid"], p @ families["y"], atol=2e-4)
    s = np.diag(rows["w"].to_numpy())
    for r in null.pairs.collect():
        s[r["i"], r["j"]] = r["value"]
    assert np.allclose(s, np.linalg.inv(tau[0] * np.eye(N) + tau[1] * families["k"]), atol=2e-4)
    assert np.allclose(rows["w1"], s.sum(axis=1)) and np.allclose(rows[["wx0", "wx1"]], s @ families["x"])

    rng = np.random.default_rng(8)
    states = rng.binomial(2, rng.choice([0.02, 0.05, 0.97], 14)[:, None], (14, N))
    states[rng.random(states.shape) < 0.02] = 3
    calls = spark.createDataFrame([(i, j, int(states[j, i])) for j in range(14) for i in range(N) if states[j, i]], "sample_idx bigint, variant_idx bigint, state int")
    called = np.where(states == 3, 0, 2).sum(1)
    ref_af = np.where(states == 3, 0, 2 - states).sum(1) / called
    maf = np.minimum(ref_af, 1 - ref_af)
    g = np.where(states == 3, 2 * maf[:, None], np.where(ref_af[:, None] >= 0.5, states, 2 - states)).T.astype(float)
    cov = np.array(model["cov"]).reshape(2, 2)
    c = (s @ families["x"]).T @ g
    v = g.T @ s @ g - c.T @ cov @ c
    for r in association.scores(calls, null).collect():
        j = r["variant_idx"]
        assert r["variance"] == pytest.approx(v[j, j], rel=1e-8) and r["score"] == pytest.approx(g[:, j] @ rows["resid"].to_numpy(), rel=1e-8, abs=1e-9)
    members = spark.createDataFrame([("G", "plof", j) for j in range(14)], "gene_name string, mask string, variant_idx bigint")
    variants = spark.createDataFrame([(j, 1.0) for j in range(14)], "variant_idx bigint, a double")
    rows = set_tests.set_tests(calls, null, variants, members, F.array("a"), ["one"], cutoff=0.2).filter("test = 'B' and annotation = '' and beta = '1,1'").collect()
    js = [j for j in range(14) if 0 < maf[j] < 0.2]
    u = g[:, js] @ np.ones(len(js)) @ null.samples.orderBy("sample_idx").toPandas()["resid"].to_numpy()
    import math

    assert rows[0]["p"] == pytest.approx(math.erfc(abs(u) / math.sqrt(2 * v[np.ix_(js, js)].sum())), rel=1e-6)
    plain = set_tests.burden_statistics(calls, null, members, cutoff=0.2).first()
    assert plain["variance"] == pytest.approx(v[np.ix_(js, js)].sum(), rel=1e-8)


def test_logistic_mixed_model_solves_its_equations(families):
    null = kinship.fit_mixed_logistic(families["binary"], families["diagonal"], families["edges"], 2)
    model = null.models.first()
    rows = null.samples.orderBy("sample_idx").toPandas()
    tau, mu = model["tau"][1], rows["mu"].to_numpy()
    assert np.allclose(rows["resid"], families["b"] - mu)
    assert np.allclose(families["x"].T @ rows["resid"].to_numpy(), 0, atol=2e-3)
    random_effect = np.log(mu / (1 - mu)) - families["x"] @ np.array(model["beta"])
    assert np.allclose(random_effect, tau * families["k"] @ rows["resid"].to_numpy(), atol=5e-3)


def test_search_recovers_a_logistic_model(spark, families, monkeypatch):
    """The search reaches the fit of the average-information steps when these are not allowed to settle."""
    args = (families["binary"], families["diagonal"], families["edges"], 2)
    want = kinship.fit_mixed_logistic(*args).models.first()
    from_search = {}
    original = kinship._search_logistic
    monkeypatch.setattr(kinship, "_search_logistic", lambda *a: from_search.setdefault("fit", original(*a[:-1], 60)))
    got = kinship.fit_mixed_logistic(*args, tolerance=1e-3, rounds=1).models.first()
    assert from_search
    assert got["tau"][1] == pytest.approx(want["tau"][1], rel=2e-2, abs=1e-3)
    assert list(got["beta"]) == pytest.approx(list(want["beta"]), rel=2e-2, abs=2e-3)


def test_large_blocks_are_refused(spark, families, monkeypatch):
    monkeypatch.setattr(kinship, "MAX_BLOCK", 2)
    with pytest.raises(ValueError, match="links"):
        kinship.fit_mixed_linear(families["design"], families["diagonal"], families["edges"], 2)


def test_subset(families, spark):
    keep = spark.createDataFrame([(0,), (1,), (4,), (0,)], "sample_idx bigint")
    diagonal, edges = kinship.subset(families["diagonal"], families["edges"], keep)
    assert sorted(r["sample_idx"] for r in diagonal.collect()) == [0, 1, 4]
    assert sorted((r["i"], r["j"]) for r in edges.collect()) == [(0, 1), (1, 0)]


def test_study_writes_every_binary_analysis(spark, families, tmp_path):
    from lodestrand.functions import numerics
    from lodestrand.plans import workflow

    rng = np.random.default_rng(3)
    states = rng.binomial(2, rng.choice([0.03, 0.06], 16)[:, None], (16, N))
    calls = spark.createDataFrame([(i, j, int(states[j, i]), "21") for j in range(16) for i in range(N) if states[j, i]], "sample_idx bigint, variant_idx bigint, state int, chrom string")
    rows = [(j, "21", 10 * j + 5, "A", "C", "PASS", "exonic", "nonsynonymous SNV", "D" if j in (1, 3, 5) else "T", "", "", "", "") for j in range(16)]
    tables = {
        "samples": spark.createDataFrame([(i, "f", str(i)) for i in range(N)], "sample_idx bigint, fid string, iid string"),
        "variants": spark.createDataFrame(rows, "variant_idx bigint, chrom string, pos bigint, ref string, alt string, qc string, category string, exonic string, metasvm string, info string, genehancer string, cage string, dhs string"),
        "calls": calls,
        "variant_stats": spark.createDataFrame([(0, "21")], "variant_idx bigint, chrom string"),
        "genes": spark.createDataFrame([(0, "G1", "21", 1, 80, None), (1, "G2", "21", 81, 200, None)], "ordinal bigint, gene_name string, chrom string, start_pos bigint, end_pos bigint, problem string"),
        "ncrnas": spark.createDataFrame([(0, "R", "21")], "ordinal bigint, gene_name string, chrom string"),
        "promoters": spark.createDataFrame([("21", 1, 3)], "chrom string, start_pos bigint, end_pos bigint"),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / "d" / name))
    spark.createDataFrame([(name, workflow.VERSION, *workflow._print_of(df)) for name, df in tables.items()], "table_name string, version int, n_rows bigint, print string").write.parquet(str(tmp_path / "d" / "dataset"))
    (tmp_path / "x.csv").write_text("FID,IID,age\n" + "".join(f"f,{i},{float(families['x'][i, 1])!r}\n" for i in range(N)))
    (tmp_path / "y.csv").write_text("FID,IID,y,b\n" + "".join(f"f,{i},{float(families['y'][i])!r},{int(families['b'][i])}\n" for i in range(N)))
    (tmp_path / "b.csv").write_text("FID,IID,b\n" + "".join(f"f,{i},{int(families['b'][i])}\n" for i in range(N)))
    run = lambda y, out, **more: workflow.run_all(spark, str(tmp_path / y), str(tmp_path / "x.csv"), str(tmp_path / "d"), str(tmp_path / out), analyses=("single", "coding"), mac_cutoff=1, rare_maf_cutoff=0.3, **more)
    read = lambda path: spark.read.csv(str(tmp_path / path), header=True).toPandas()

    assert {"single", "coding", "coding_binary", "coding_binary_summaries"} == set(run("y.csv", "plain")["rows"])
    single = read("plain/single")
    assert single.loc[single["trait"] == "b", "normal_pvalue"].notna().all() and single.loc[single["trait"] == "y", "normal_pvalue"].isna().all()
    table = read("plain/coding").set_index(["Gene name", "Category"])
    assert table.loc[("G1", "missense"), "Burden(1,1)-Disruptive"] == table.loc[("G1", "disruptive_missense"), "Burden(1,1)"]
    assert float(table.loc[("G2", "missense"), "SKAT(1,25)-Disruptive"]) == 1.0
    names = read("plain/coding_binary_summaries").set_index(["gene_name", "mask", "name"])["p"]
    assert {"WGS-B", "WGS-B(1,1)", "WGS-B(1,25)", "Burden(1,1)-Disruptive", "Burden(1,25)-Disruptive"} == set(names.loc["G1", "missense"].index)

    mixed = run("b.csv", "mixed", null_fit_mode="mixed", grm=(families["diagonal"], families["edges"]))
    assert mixed["rows"]["coding_binary"] > 0 and mixed["rows"]["coding_binary_summaries"] > 0
    null = kinship.fit_mixed_logistic(families["binary"], families["diagonal"], families["edges"], 2)
    samples = null.samples.orderBy("sample_idx").toPandas()
    s, x = np.diag(samples["w"].to_numpy()), families["x"]
    for r in null.pairs.collect():
        s[r["i"], r["j"]] = r["value"]
    maf = states.sum(1) / (2 * N)
    members = spark.createDataFrame([("G", "plof", j) for j in range(16)], "gene_name string, mask string, variant_idx bigint")
    got = set_tests.binary_burdens(calls.drop("chrom"), null, spark.createDataFrame([(j, 1.0) for j in range(16)], "variant_idx bigint, a double"), members, F.array("a"), ["one"], cutoff=0.3, p_filter=1.1)
    got = got.filter("beta = '1,1' and annotation = ''").first()
    burden = states[(maf > 0) & (maf < 0.3)].sum(0).astype(float)
    cov = np.linalg.inv(x.T @ s @ x)
    projected = burden - x @ (cov @ (x.T @ s @ burden))
    assert got["variance"] == pytest.approx(burden @ s @ projected, rel=1e-6)
    assert got["p"] == pytest.approx(numerics.binary_spa(float(burden @ samples["resid"]), projected, samples["mu"].to_numpy())[0], rel=1e-4)
