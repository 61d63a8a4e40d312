import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.functions import numerics
from lodestrand.operators import joint

N, M = 120, 10


def test_joint_tests_against_kronecker_matrices(spark):
    rng = np.random.default_rng(2)
    states = rng.binomial(2, rng.choice([0.02, 0.04, 0.97], M)[:, None], (M, N))
    x = np.column_stack([np.ones(N), rng.standard_normal(N)])
    y = x @ rng.standard_normal((2, 2)) + rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 2]], N)
    design = spark.createDataFrame([(f"t{t}", i, float(y[i, t]), *map(float, x[i])) for t in range(2) for i in range(N)] + [("t0", N, 1.0, 1.0, 1.0)], "trait string, sample_idx bigint, y double, x0 double, x1 double")
    calls = spark.createDataFrame([(i, j, int(states[j, i])) for j in range(M) for i in range(N) if states[j, i]], "sample_idx bigint, variant_idx bigint, state int")
    model = joint.fit_joint(design, ["t0", "t1"], 2)
    r = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    s = r.T @ r / (N - 2)
    assert np.allclose(model.covariance, s)
    inverse = np.linalg.inv(s)
    alt = states.sum(1) / (2 * N)
    g = np.where(alt[:, None] <= 0.5, states, 2 - states).T.astype(float)
    maf = np.minimum(alt, 1 - alt)
    v1 = g.T @ g - g.T @ x @ np.linalg.inv(x.T @ x) @ x.T @ g
    u = g.T @ r @ inverse
    for row in joint.joint_single(calls, model, mac_cutoff=1).collect():
        j = row["variant_idx"]
        q = u[j] @ np.linalg.inv(inverse * v1[j, j]) @ u[j]
        assert row["pvalue"] == pytest.approx(math.exp(-q / 2), rel=1e-7) and row["score2"] == pytest.approx(u[j, 1], rel=1e-7)
    members = spark.createDataFrame([("G", "plof", j) for j in range(M)], "gene_name string, mask string, variant_idx bigint")
    variants = spark.createDataFrame([(j, float(j)) for j in range(M)], "variant_idx bigint, a double")
    rows = {(r["test"], r["beta"]): r["p"] for r in joint.joint_set_tests(calls, model, variants, members, F.array("a"), ["one"], cutoff=0.2).filter("annotation = ''").collect()}
    js = [j for j in range(M) if 0 < maf[j] < 0.2]
    whole = np.kron(inverse, v1[np.ix_(js, js)])
    stacked = u[js].T.ravel()
    assert rows["S", "1,1"] == pytest.approx(numerics.quadratic_form_sf(float(stacked @ stacked), np.linalg.eigvalsh(whole)), rel=1e-3)
    score, variance = u[js].sum(0), v1[np.ix_(js, js)].sum()
    assert rows["B", "1,1"] == pytest.approx(math.exp(-(score @ s @ score) / variance / 2), rel=1e-7)
    assert 0 < rows["A", "1,25"] < 1
