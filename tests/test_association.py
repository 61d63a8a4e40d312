"""The whole association path against dense NumPy matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.functions import numerics
from lodestrand.operators import association, genotypes, null_models, set_tests

N, M = 160, 24
CALLED = np.array([2, 2, 2, 0, 1, 1])
REFERENCE = np.array([2, 1, 0, 0, 1, 0])


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(11)
    states = np.zeros((M, N), int)
    for j in range(M):
        rate = rng.choice([0.004, 0.01, 0.03, 0.97])
        states[j] = rng.binomial(2, rate, N)
        states[j, rng.random(N) < 0.02] = 3
        states[j, rng.random(N) < 0.01] = rng.choice([4, 5])
    states[0] = 0
    x = np.column_stack([np.ones(N), rng.standard_normal(N), rng.integers(0, 3, N)])
    y = x @ [1.0, 0.5, -0.3] + rng.standard_normal(N) + 0.4 * (states[5] == 1)
    b = (rng.random(N) < 1 / (1 + np.exp(-(x @ [-1.2, 0.6, 0.2])))).astype(float)
    cohort = {"y": np.arange(N) % 9 != 0, "b": np.arange(N) % 7 != 3}
    rows = [(t, i, float(v[i]), *map(float, x[i])) for t, v in (("y", y), ("b", b)) for i in range(N) if cohort[t][i]]
    design = spark.createDataFrame(rows, "trait string, sample_idx bigint, y double, x0 double, x1 double, x2 double")
    calls = spark.createDataFrame([(int(i), int(j), int(states[j, i])) for j in range(M) for i in range(N) if states[j, i]], "sample_idx bigint, variant_idx bigint, state int")
    variants = spark.createDataFrame([(j, "21", 10 * j, "A", "C", float(j % 7), float(j % 5 + 1)) for j in range(M)], "variant_idx bigint, chrom string, pos bigint, ref string, alt string, a double, b double")
    null = null_models.fit_linear(design.filter("trait = 'y'"), 3).union(null_models.fit_logistic(design.filter("trait = 'b'"), 3))
    return {"states": states, "x": x, "y": {"y": y, "b": b}, "cohort": cohort, "design": design, "calls": calls, "variants": variants, "null": null}


def dense(study, trait):
    """Residuals, weights, projection and minor dosages of a trait's cohort by matrix algebra."""
    keep = study["cohort"][trait]
    x, y, s = study["x"][keep], study["y"][trait][keep], study["states"][:, keep]
    if trait == "y":
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        raw = y - x @ beta
        sigma2 = raw @ raw / (len(y) - 3)
        r, w, mu = raw / sigma2, np.full(len(y), 1 / sigma2), None
    else:
        beta = np.zeros(3)
        for _ in range(60):
            mu = 1 / (1 + np.exp(-x @ beta))
            beta = beta + np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x, x.T @ (y - mu))
        mu = 1 / (1 + np.exp(-x @ beta))
        r, w = y - mu, mu * (1 - mu)
    ref_af = REFERENCE[s].sum(1) / CALLED[s].sum(1)
    maf = np.minimum(ref_af, 1 - ref_af)
    g = np.where(ref_af[:, None] >= 0.5, s, 2.0 - s)
    g = np.where(s >= 3, 2 * maf[:, None], g).T.astype(float)
    cov = np.linalg.inv((x * w[:, None]).T @ x)
    c = (x * w[:, None]).T @ g
    return {"n": len(y), "x": x, "r": r, "w": w, "mu": mu, "beta": beta, "g": g, "maf": maf, "u": g.T @ r, "v": (g * w[:, None]).T @ g - c.T @ cov @ c, "cov": cov, "s": s}


@pytest.mark.parametrize("trait", ["y", "b"])
def test_null_models_and_scores(study, trait):
    d = dense(study, trait)
    model = study["null"].models.filter(F.col("trait") == trait).first()
    assert model["n"] == d["n"] and np.allclose(model["beta"], d["beta"], rtol=1e-7, atol=1e-9)
    assert np.allclose(np.array(model["cov"]).reshape(3, 3), d["cov"], rtol=1e-6)
    rows = association.scores(study["calls"], study["null"]).filter(F.col("trait") == trait).collect()
    assert {r["variant_idx"] for r in rows} == {j for j in range(M) if d["s"][j].any()}
    for r in rows:
        j = r["variant_idx"]
        assert r["score"] == pytest.approx(d["u"][j], rel=1e-8, abs=1e-9) and r["variance"] == pytest.approx(d["v"][j, j], rel=1e-8, abs=1e-9)
        assert r["maf"] == pytest.approx(d["maf"][j]) and r["initial_mac"] == min(r["alt_ac"], r["ref_ac"])


def test_single_variant_p_and_order(study):
    d = dense(study, "y")
    rows = association.single_variant(study["calls"], study["null"], study["variants"], mac_cutoff=2, chunk=4).filter("trait = 'y'").orderBy(*association.SINGLE_ORDER).collect()
    assert [r["ordinal"] for r in rows] == list(range(len(rows))) and [r["chunk"] for r in rows] == [i // 4 for i in range(len(rows))]
    for r in rows:
        j = r["variant_idx"]
        z = d["u"][j] / math.sqrt(d["v"][j, j])
        assert r["pvalue"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-7) and r["est"] == pytest.approx(d["u"][j] / d["v"][j, j], rel=1e-7)


def members_of(spark):
    rows = [("G1", "plof", j) for j in range(0, 12)] + [("G1", "missense", j) for j in range(4, 20)] + [("G1", "disruptive_missense", j) for j in range(4, 9)] + [("G2", "plof", j) for j in (1, 2)] + [("G3", "missense", j) for j in range(10, 24)]
    return spark.createDataFrame(rows, "gene_name string, mask string, variant_idx bigint")


def expected_sets(study, members, trait, cutoff):
    d, out = dense(study, trait), {}
    phred = np.array([[j % 7, j % 5 + 1] for j in range(M)], float)
    for gene, mask in {(r["gene_name"], r["mask"]) for r in members}:
        js = [r["variant_idx"] for r in members if (r["gene_name"], r["mask"]) == (gene, mask) and 0 < d["maf"][r["variant_idx"]] < cutoff]
        if len(js) < 2:
            continue
        maf = d["maf"][js]
        rank = np.column_stack([np.ones(len(js)), 1 - 10 ** (-phred[js] / 10)])
        w25 = 25 * (1 - maf) ** 24
        b = np.hstack([rank * w25[:, None], rank])
        s = np.hstack([np.sqrt(rank) * w25[:, None], np.sqrt(rank)])
        a = np.hstack([rank * (w25**2)[:, None], rank]) * (np.pi**2 * maf * (1 - maf))[:, None]
        out[gene, mask] = (js, {"B": b, "S": s, "A": a}, d)
    return out


def test_set_tests(spark, study):
    members = members_of(spark)
    long = set_tests.set_tests(study["calls"], study["null"], study["variants"], members, F.array("a", "b"), ["one", "two"], cutoff=0.05)
    rows = long.filter("trait = 'y'").collect()
    want = expected_sets(study, members.collect(), "y", 0.05)
    assert {(r["gene_name"], r["mask"]) for r in rows} == set(want)
    labels = [(b, n) for b in ("1,25", "1,1") for n in ("", "one", "two")]
    for (gene, mask), (js, weights, d) in want.items():
        u, v, mac = d["u"][js], d["v"][np.ix_(js, js)], np.rint(d["maf"][js] * 2 * d["n"])
        own = {(r["test"], r["beta"], r["annotation"]): r for r in rows if (r["gene_name"], r["mask"]) == (gene, mask)}
        assert len(own) == 18
        for i, label in enumerate(labels):
            wb, ws, wa = (weights[k][:, i] for k in "BSA")
            burden = math.erfc(abs(wb @ u) / math.sqrt(2 * (wb @ v @ wb)))
            assert own["B", *label]["p"] == pytest.approx(burden, rel=1e-6)
            skat = numerics.quadratic_form_sf(float((u**2 * ws**2).sum()), np.linalg.eigvalsh(v * np.outer(ws, ws)))
            assert own["S", *label]["p"] == pytest.approx(skat, rel=1e-3)
            ps = [math.erfc(abs(u[k]) / math.sqrt(2 * v[k, k])) for k in range(len(js)) if mac[k] > 10]
            pw = [wa[k] for k in range(len(js)) if mac[k] > 10]
            few = mac <= 10
            if few.any():
                ps.append(math.erfc(abs(wb[few] @ u[few]) / math.sqrt(2 * (wb[few] @ v[np.ix_(few, few)] @ wb[few]))))
                pw.append(wa[few].mean())
            assert own["A", *label]["p"] == pytest.approx(numerics.cauchy(ps, pw), rel=1e-5)
            assert own["B", *label]["n_variants"] == len(js) and own["B", *label]["cmac"] == pytest.approx(d["g"][:, js].sum(), rel=1e-9)
    table = set_tests.wide(long, ["one", "two"], "21").filter("trait = 'y'")
    assert table.columns == ["trait", "Gene name", "Chr", "Category", "#SNV", "cMAC", *set_tests.column_order(["one", "two"])]
    first = {(r["Gene name"], r["Category"]): r for r in table.collect()}
    ps = [r["p"] for r in rows if (r["gene_name"], r["mask"]) == ("G1", "plof")]
    assert first["G1", "plof"]["WGS-O"] == pytest.approx(numerics.cauchy(ps), rel=1e-9)
    extra = {(r["gene_name"], r["name"]): r["p"] for r in set_tests.with_disruptive(long.filter("trait = 'y'")).collect()}
    assert extra["G3", "SKAT(1,25)-Disruptive"] == 1.0 and extra["G3", "WGS-O"] == pytest.approx(first["G3", "missense"]["WGS-O"])
    base = [r["p"] for r in rows if (r["gene_name"], r["mask"]) == ("G1", "missense")] + [r["p"] for r in rows if (r["gene_name"], r["mask"], r["annotation"]) == ("G1", "disruptive_missense", "")]
    assert extra["G1", "WGS-O"] == pytest.approx(numerics.cauchy(base), rel=1e-9)
    assert extra["G1", "ACAT-O"] == pytest.approx(first["G1", "missense"]["ACAT-O"])


def test_binary_burdens_and_single(spark, study):
    members = members_of(spark)
    want = expected_sets(study, members.collect(), "b", 0.05)
    null = null_models.NullModel(study["null"].samples.filter("trait = 'b'"), study["null"].models.filter("trait = 'b'"), 3)
    burdens = set_tests.binary_burdens(study["calls"], null, study["variants"], members, F.array("a", "b"), ["one", "two"], cutoff=0.05, p_filter=1.1)
    rows = burdens.collect()
    extra = {(r["gene_name"], r["name"]): r["p"] for r in set_tests.binary_with_disruptive(burdens).collect()}
    assert extra["G3", "Burden(1,1)-Disruptive"] == 1.0 and ("G3", "WGS-B") not in extra
    ps = [r["p"] for r in rows if (r["gene_name"], r["mask"]) == ("G1", "missense")] + [r["p"] for r in rows if (r["gene_name"], r["mask"], r["annotation"]) == ("G1", "disruptive_missense", "")]
    assert extra["G1", "WGS-B"] == pytest.approx(numerics.cauchy([p for p in ps if p < 1]), rel=1e-9)
    assert {(r["gene_name"], r["mask"]) for r in rows} == set(want)
    labels = [(b, n) for b in ("1,25", "1,1") for n in ("", "one", "two")]
    for (gene, mask), (js, weights, d) in want.items():
        for i, (beta, name) in enumerate(labels):
            r = next(r for r in rows if (r["gene_name"], r["mask"], r["beta"], r["annotation"]) == (gene, mask, beta, name))
            burden = d["g"][:, js] @ weights["B"][:, i]
            projected = burden - d["x"] @ (d["cov"] @ ((d["x"] * d["w"][:, None]).T @ burden))
            p, failed = numerics.binary_spa(float(burden @ d["r"]), projected, d["mu"])
            assert r["score"] == pytest.approx(burden @ d["r"], rel=1e-6, abs=1e-8) and r["variance"] == pytest.approx((projected**2 * d["w"]).sum(), rel=1e-6)
            assert r["p"] == pytest.approx(p, rel=1e-5)
    d = dense(study, "b")
    single = set_tests.binary_single(study["calls"], null, mac_cutoff=2, p_filter=0.5).collect()
    assert single
    for r in single:
        j = r["variant_idx"]
        assert r["p_normal"] == pytest.approx(math.erfc(abs(d["u"][j]) / math.sqrt(2 * d["v"][j, j])), rel=1e-6)
        if r["p_normal"] < 0.5:
            projected = d["g"][:, j] - d["x"] @ (d["cov"] @ ((d["x"] * d["w"][:, None]).T @ d["g"][:, j]))
            assert r["p"] == pytest.approx(numerics.binary_spa(float(d["u"][j]), projected, d["mu"])[0], rel=1e-5)


def test_singular_design_separation_and_values(spark, study):
    twice = study["design"].filter("trait = 'y'").withColumn("x2", F.col("x1"))
    with pytest.raises(Exception, match="singular"):
        null_models.fit_linear(twice, 3)
    with pytest.raises(ValueError, match="0 and 1"):
        null_models.fit_logistic(study["design"].filter("trait = 'y'"), 3)
    parted = spark.createDataFrame([("t", i, float(i > 20), 1.0, float(i)) for i in range(40)], "trait string, sample_idx bigint, y double, x0 double, x1 double")
    with pytest.raises(ValueError):
        null_models.fit_logistic(parted, 2)


def test_design_helpers(spark):
    rows = [("t", i, float(i % 5), 1.0, float(i), float(2 * i + 1), float(i * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "trait string, sample_idx bigint, y double, one double, a double, b double, c double")
    assert null_models.independent_columns(df, ["a", "b", "c", "one"]) == {"t": ["a", "c"]}
    assert null_models.needs_intercept(df, ["a", "one"]).first()["needs_intercept"] is False
    assert null_models.needs_intercept(df, ["a", "b"]).first()["needs_intercept"] is True
    scaled = null_models.standardised(df, ["a", "one"]).agg(F.mean("a"), F.stddev_samp("a"), F.max(F.abs("one"))).first()
    assert scaled[0] == pytest.approx(0, abs=1e-12) and scaled[1] == pytest.approx(1) and scaled[2] == 0


def test_frequency_ties_and_uncalled(spark):
    counts = spark.createDataFrame([(1, 10, 20, 0, 10, 10), (2, 0, 0, 10, 0, 10), (3, 7, 19, 0, 12, 10)], "variant_idx bigint, ref_ac bigint, called bigint, n_missing bigint, alt_sum bigint, n bigint")
    rows = {r["variant_idx"]: r for r in genotypes.frequencies(counts).collect()}
    assert rows[1]["counts_alt"] and rows[1]["maf"] == 0.5 and rows[2]["maf"] is None and rows[2]["initial_mac"] is None
    assert rows[3]["alt_ac"] == 2 * round(9.5) - 7


def test_student_calibration_and_saved_models(spark, study, tmp_path):
    linear = null_models.NullModel(study["null"].samples.filter("trait = 'y'"), study["null"].models.filter("trait = 'y'"), 3)
    null_models.save_model(linear, str(tmp_path / "m"))
    again = null_models.load_model(spark, str(tmp_path / "m"))
    assert again.p == 3 and again.pairs is None
    members = spark.createDataFrame([("G", "plof", j) for j in range(M)], "gene_name string, mask string, variant_idx bigint")
    rows = set_tests.set_tests(study["calls"], again, study["variants"], members, F.array("a").cast("array<double>"), ["one"], cutoff=0.05, student_acat=True).filter("annotation = '' and beta = '1,1' and test = 'A'").collect()
    d = dense(study, "y")
    js = [j for j in range(M) if 0 < d["maf"][j] < 0.05]
    mac, dof = np.rint(d["maf"] * 2 * d["n"]), d["n"] - 3
    ps, ws = [], []
    for j in js:
        if mac[j] > 10:
            e = d["u"][j] ** 2 / d["v"][j, j]
            ps.append(numerics.student_two_sided(e / (dof - e) * (dof - 1), dof - 1))
            ws.append(math.pi**2 * d["maf"][j] * (1 - d["maf"][j]))
    few = [j for j in js if mac[j] <= 10]
    if few:
        ps.append(math.erfc(abs(d["u"][few].sum()) / math.sqrt(2 * d["v"][np.ix_(few, few)].sum())))
        ws.append(np.mean([math.pi**2 * d["maf"][j] * (1 - d["maf"][j]) for j in few]))
    assert rows[0]["p"] == pytest.approx(numerics.cauchy(ps, ws), rel=1e-6)


def test_long_masks_switch_to_leading_eigenvalues(study):
    d = dense(study, "y")
    js = [j for j in range(M) if 0 < d["maf"][j] < 0.05]
    v, u, mac = d["v"][np.ix_(js, js)], d["u"][js], np.rint(d["maf"][js] * 2 * d["n"])
    weights = {k: np.ones((len(js), 2)) for k in "BSA"}
    whole = set_tests.mask_p_values(u, v, mac, weights)["S"]
    for method in ("residual", "liu"):
        short = set_tests.mask_p_values(u, v, mac, weights, long_threshold=3, long_rank=len(js) - 2, long_method=method)["S"]
        assert short == pytest.approx(whole, rel=0.1)
