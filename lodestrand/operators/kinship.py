"""Null models of related samples.

A relationship matrix is a diagonal and sparse off-diagonal entries; related samples fall into
connected blocks, and everything a mixed model needs is a sum over blocks. Each block is held by one
task, densely; a matrix with a block above MAX_BLOCK samples is refused. The linear model rotates its blocks by
their eigenvectors once; after that each fitting round is a plain aggregation over all samples and
traits. The logistic model's weights change, so each round takes its block sums anew.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .blocks import matrix_blocks
from .null_models import NullModel, fit_logistic

#: Samples whose blocks one task works through, about.
BUCKET_SAMPLES = 20_000
#: Samples of the largest block that is fitted; its matrix of doubles then takes half a gigabyte.
MAX_BLOCK = 8_000
#: Fixed bounds of the search that recovers a logistic model, and how many points each of its passes tries.
SEARCH, SEARCH_POINTS = (1e-5, 1e5), 33
#: Halvings of a step before a fit is given up.
MAX_HALVINGS = 2_048


def subset(diagonal: DataFrame, edges: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries among ``samples`` (sample_idx): diagonal (sample_idx, value), edges (i, j, value) with both ends among them."""
    ids = samples.select("sample_idx").distinct()
    kept = edges.join(ids.withColumnRenamed("sample_idx", "i"), "i", "left_semi").join(ids.withColumnRenamed("sample_idx", "j"), "j", "left_semi")
    return diagonal.join(ids, "sample_idx", "left_semi"), kept.select("i", "j", "value")


def block_rows(design: DataFrame, diagonal: DataFrame, edges: DataFrame, p: int) -> DataFrame:
    """The design with bucket, block, diagonal entry and relatives (array of j, value) of every row, as a stored table.

    Edges may be given in either direction or both; loops and zeros do not link. Samples without a
    diagonal entry count as 1.
    """
    links = edges.filter("i <> j and value <> 0").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "value").dropDuplicates(["i", "j"])
    groups = matrix_blocks(links).select(F.col("index").alias("sample_idx"), "block")
    both = links.unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    relatives = both.groupBy(F.col("i").alias("sample_idx")).agg(F.collect_list(F.struct("j", "value")).alias("relatives"))
    rows = design.join(groups, "sample_idx", "left").join(relatives, "sample_idx", "left").join(diagonal.withColumnRenamed("value", "own"), "sample_idx", "left")
    block = F.coalesce("block", "sample_idx")
    buckets = max(1, math.ceil(design.select("sample_idx").distinct().count() / BUCKET_SAMPLES))
    whole = stored(
        rows.select("trait", "sample_idx", "y", *(f"x{i}" for i in range(p)), block.alias("block"), F.pmod(F.xxhash64(block), F.lit(buckets)).alias("bucket"), F.coalesce("own", F.lit(1.0)).alias("own"), "relatives"), "block_rows"
    )
    largest = whole.groupBy("trait", "block").count().agg(F.max("count")).first()[0] or 0  # one row
    if largest > MAX_BLOCK:
        raise ValueError(f"a block of the relationship matrix links {largest} samples, above {MAX_BLOCK}; drop distant relations first")
    return whole


def _blocks(rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Every block's rows and dense relationship matrix."""
    for _, part in rows.groupby("block", sort=False):
        matrix = np.diag(part["own"].to_numpy(float))
        if len(part) > 1:
            place = {s: k for k, s in enumerate(part["sample_idx"])}
            for k, relatives in enumerate(part["relatives"]):
                for r in relatives if relatives is not None else ():
                    if r["j"] in place:
                        matrix[k, place[r["j"]]] = r["value"]
        yield part, matrix


def _rotated(rows: DataFrame, p: int) -> DataFrame:
    x = [f"x{i}" for i in range(p)]

    def rotate(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        alone = ~part["block"].duplicated(keep=False)
        singles = part[alone]
        out = [pd.DataFrame({"trait": singles["trait"], "d": singles["own"], "y": singles["y"], **{c: singles[c] for c in x}})]
        for own, matrix in _blocks(part[~alone]):
            values, vectors = np.linalg.eigh(matrix)
            turned = vectors.T @ own[["y", *x]].to_numpy(float)
            out.append(pd.DataFrame({"trait": key[0], "d": values, "y": turned[:, 0], **{c: turned[:, k + 1] for k, c in enumerate(x)}}))
        return pd.concat(out)

    schema = "trait string, d double, y double, " + ", ".join(f"{c} double" for c in x)
    return stored(rows.groupBy("trait", "bucket").applyInPandas(rotate, schema), "rotated")


def _moments(rotated: DataFrame, taus: dict[str, tuple[float, float]], p: int) -> dict[str, dict[tuple[int, int], np.ndarray]]:
    """Per trait the sums of v^k d^l z z' for z = (x, y) and v = 1 / (tau0 + tau1 d), with sums of v and v d under (1, 0, 't')."""
    spark = rotated.sparkSession
    table = spark.createDataFrame([(t, float(a), float(b)) for t, (a, b) in taus.items()], "trait string, tau0 double, tau1 double")
    v = 1 / (F.col("tau0") + F.col("tau1") * F.col("d"))
    z = [*(f"x{i}" for i in range(p)), "y"]
    orders = [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
    rows = rotated.join(F.broadcast(table), "trait").withColumn("v", v)
    weights = {o: F.pow(F.col("v"), F.lit(float(o[0]))) * F.pow(F.col("d"), F.lit(float(o[1]))) for o in orders}
    rows = rows.withColumns({f"w{k}{l}": w for (k, l), w in weights.items()})
    sums = [F.array(*(F.sum(F.col(f"w{k}{l}") * F.col(z[a]) * F.col(z[b])) for a in range(p + 1) for b in range(a, p + 1))).alias(f"m{k}{l}") for k, l in orders]
    got = rows.groupBy("trait").agg(F.sum("v").alias("tv"), F.sum(F.col("v") * F.col("d")).alias("tvd"), *sums).collect()  # one row per trait
    out = {}
    for r in got:
        square = {}
        for k, l in orders:
            m = np.zeros((p + 1, p + 1))
            m[np.triu_indices(p + 1)] = r[f"m{k}{l}"]
            square[k, l] = m + np.triu(m, 1).T
        out[r["trait"]] = square | {"tv": r["tv"], "tvd": r["tvd"]}
    return out


def _reml_step(m: dict, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(beta, cov, score, average information) for both components from the moments."""
    xx, xy = m[1, 0][:p, :p], m[1, 0][:p, p]
    cov = np.linalg.inv(xx)
    beta = cov @ xy
    c = np.append(-beta, 1.0)  # y - x beta
    quad = lambda o: c @ m[o] @ c
    traces = np.array([m["tv"] - np.trace(cov @ m[2, 0][:p, :p]), m["tvd"] - np.trace(cov @ m[2, 1][:p, :p])])
    score = np.array([quad((2, 0)), quad((2, 1))]) - traces
    cross = np.stack([(m[2, 0] @ c)[:p], (m[2, 1] @ c)[:p]])
    information = np.array([[quad((3, 0)), quad((3, 1))], [quad((3, 1)), quad((3, 2))]]) - cross @ cov @ cross.T
    return beta, cov, score, information


def fit_mixed_linear(design: DataFrame, diagonal: DataFrame, edges: DataFrame, p: int, tolerance: float = 1e-5, rounds: int = 100) -> NullModel:
    """Linear mixed model y = x beta + e, cov(e) = tau0 I + tau1 K, by average-information REML for all traits together.

    Start at half the variance each, one expectation-maximization step, then halved steps that keep
    both components non-negative; a component at its boundary is fixed at 0 and the rest refitted.
    Missing convergence is an error.
    """
    rows = block_rows(design, diagonal, edges, p)
    rotated = _rotated(rows, p)
    start = {r["trait"]: (r["n"], r["v"], r["k"]) for r in rows.groupBy("trait").agg(F.count(F.lit(1)).alias("n"), F.var_samp("y").alias("v"), F.mean("own").alias("k")).collect()}
    fixed = {t: np.zeros(2, bool) for t in start}
    done: dict[str, tuple] = {}
    for _refit in range(5):
        todo = [t for t in start if t not in done]
        if not todo:
            break
        tau = {}
        for t in todo:
            n, v, k = start[t]
            tau[t] = np.where(fixed[t], 0.0, [v / 2, v / 2 / k])
        for t, m in _moments(rotated, tau, p).items():
            _, _, score, _ = _reml_step(m, p)
            tau[t] = np.where(fixed[t], 0.0, np.maximum(tau[t] + tau[t] ** 2 * score / start[t][0], 0.0))
        beta_before: dict[str, np.ndarray] = {}
        open_traits = set(todo)
        settled: dict[str, tuple] = {}
        for _ in range(rounds):
            for t, m in _moments(rotated, {t: tau[t] for t in open_traits}, p).items():
                beta, cov, score, information = _reml_step(m, p)
                old, free = tau[t].copy(), ~fixed[t]
                if free.any():
                    step = np.zeros(2)
                    step[free] = np.linalg.solve(information[np.ix_(free, free)], score[free])
                    for _halving in range(MAX_HALVINGS):
                        new = old + step
                        new[(new < tolerance) & (old < tolerance)] = 0
                        if (new >= 0).all():
                            break
                        step /= 2
                    else:
                        raise ArithmeticError(f"the variance components of {t} leave their range")
                    new[new < tolerance] = 0
                    tau[t] = new
                before = beta_before.get(t, np.zeros(p))
                change = 2 * max(np.max(np.abs(beta - before) / (np.abs(beta) + np.abs(before) + tolerance)), np.max(np.abs(tau[t] - old) / (np.abs(tau[t]) + np.abs(old) + tolerance)))
                beta_before[t] = beta
                if change < tolerance:
                    settled[t] = (beta, cov, old, tau[t])
                    open_traits.discard(t)
            if not open_traits:
                break
        else:
            raise ArithmeticError(f"no convergence for {sorted(open_traits)}")
        for t, fit in settled.items():
            at_zero = tau[t] < 1.01 * tolerance
            if (at_zero == fixed[t]).all():
                done[t] = fit
            fixed[t] = at_zero
    if set(done) != set(start):
        raise ArithmeticError("boundary refits did not settle")

    def precision(key: tuple, own: pd.DataFrame, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        beta, _, old, _ = done[key[0]]
        inverse = np.linalg.inv(old[0] * np.eye(len(own)) + old[1] * matrix)
        x = own[[f"x{i}" for i in range(p)]].to_numpy(float)
        return inverse, inverse @ x, inverse @ (own["y"].to_numpy(float) - x @ beta), np.full(len(own), np.nan)

    return _finish(rows, p, precision, {t: (fit[0], fit[1], fit[3]) for t, fit in done.items()}, "gaussian")


def _finish(rows: DataFrame, p: int, precision: Callable, fits: dict[str, tuple], family: str) -> NullModel:
    """The model tables from each block's precision matrix, its product with the design, residuals and means."""
    x = [f"x{i}" for i in range(p)]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, matrix in _blocks(part):
            inverse, sx, resid, mu = precision(key, own, matrix)
            ids = own["sample_idx"].to_numpy()
            others = [[{"j": int(ids[b]), "value": float(inverse[a, b])} for b in range(len(ids)) if a != b and inverse[a, b] != 0] for a in range(len(ids))]
            out.append(
                pd.DataFrame(
                    {"trait": key[0], "sample_idx": ids, "resid": resid, "w": np.diag(inverse), "w1": inverse.sum(axis=1), "mu": mu, **{c: own[c].to_numpy() for c in x}, **{f"wx{k}": sx[:, k] for k in range(p)}, "others": others}
                )
            )
        return pd.concat(out)

    schema = "trait string, sample_idx bigint, resid double, w double, w1 double, mu double, " + ", ".join(f"{c} double" for c in [*x, *(f"wx{k}" for k in range(p))]) + ", others array<struct<j:bigint,value:double>>"
    full = stored(rows.groupBy("trait", "bucket").applyInPandas(run, schema), "null_samples")
    samples = full.drop("others").withColumn("mu", F.when(~F.isnan("mu"), F.col("mu")))
    spark = rows.sparkSession
    table = spark.createDataFrame([(t, family, [float(b) for b in beta], [float(c) for c in cov.ravel()], float(tau[0]), [float(v) for v in tau]) for t, (beta, cov, tau) in fits.items()], "trait string, family string, beta array<double>, cov array<double>, sigma2 double, tau array<double>")
    sums = samples.groupBy("trait").agg(F.count(F.lit(1)).alias("n"), F.sum("resid").alias("r0"), F.sum("w1").alias("w0"), F.array(*(F.sum(f"wx{i}") for i in range(p))).alias("xw0"))
    pairs = full.select("trait", F.col("sample_idx").alias("i"), F.explode("others").alias("o")).select("trait", "i", F.col("o.j").alias("j"), "o.value")
    return NullModel(samples, stored(table.join(sums, "trait"), "null_models"), p, pairs)


def fit_mixed_logistic(design: DataFrame, diagonal: DataFrame, edges: DataFrame, p: int, tolerance: float = 1e-5, rounds: int = 100) -> NullModel:
    """Logistic mixed model with random effects of covariance tau K, by penalised quasi-likelihood.

    Each round weighs the working response by the current means and takes one average-information
    step for tau (halved while negative); two passes over the blocks. Traits that do not settle so
    start anew, and each of their rounds searches the restricted likelihood of its working response
    for the best tau within SEARCH (on a logarithmic grid, narrowed until it is as fine as the
    tolerance); a tau at its lower end is refitted as 0. Missing convergence is then an error.
    """
    x = [f"x{i}" for i in range(p)]
    rows = block_rows(design, diagonal, edges, p)
    plain = fit_logistic(design, p)
    eta = stored(plain.samples.select("trait", "sample_idx", F.log(F.col("mu") / (1 - F.col("mu"))).alias("eta")), "eta")
    fits: dict[str, tuple[np.ndarray, float]] = {r["trait"]: (np.array(r["beta"]), -1.0) for r in plain.models.collect()}
    settled: dict[str, tuple] = {}

    def working(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mu = 1 / (1 + np.exp(-part["eta"].to_numpy(float)))
        w = np.maximum(mu * (1 - mu), 1e-12)
        return part["eta"].to_numpy(float) + (part["y"].to_numpy(float) - mu) / w, w, mu

    def sums_at(state: DataFrame, taus: dict[str, float]) -> dict[str, tuple]:
        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            m0, m1, m2, trace = np.zeros((p + 1, p + 1)), np.zeros((p + 1, p + 1)), np.zeros((p + 1, p + 1)), 0.0
            for own, k in _blocks(part):
                z, w, _ = working(own)
                inverse = np.linalg.inv(np.diag(1 / w) + taus[key[0]] * k)
                both = np.column_stack([own[x].to_numpy(float), z])
                s = inverse @ both
                ks = k @ s
                m0, m1, m2, trace = m0 + both.T @ s, m1 + s.T @ ks, m2 + ks.T @ inverse @ ks, trace + float((inverse * k).sum())
            return pd.DataFrame({"trait": [key[0]], "sums": [np.concatenate([m0.ravel(), m1.ravel(), m2.ravel(), [trace]]).tolist()]})

        size = 3 * (p + 1) ** 2 + 1
        per_bucket = state.groupBy("trait", "bucket").applyInPandas(run, "trait string, sums array<double>")
        got = per_bucket.groupBy("trait").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(size))).alias("sums")).collect()  # one row per trait
        shape = (p + 1, p + 1)
        q = (p + 1) ** 2
        return {r["trait"]: tuple(np.array(r["sums"][i * q : (i + 1) * q]).reshape(shape) for i in range(3)) + (r["sums"][-1],) for r in got}

    def moved(state: DataFrame, taus: dict[str, float], betas: dict[str, np.ndarray]) -> DataFrame:
        """The linear predictors that follow from tau and beta."""

        def update(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            out = []
            for own, k in _blocks(part):
                z, w, _ = working(own)
                residual = np.linalg.solve(np.diag(1 / w) + taus[key[0]] * k, z - own[x].to_numpy(float) @ betas[key[0]])
                out.append(pd.DataFrame({"trait": key[0], "sample_idx": own["sample_idx"].to_numpy(), "eta": z - residual / w}))
            return pd.concat(out)

        return stored(state.groupBy("trait", "bucket").applyInPandas(update, "trait string, sample_idx bigint, eta double"), "eta")

    def change_of(beta: np.ndarray, before: np.ndarray, new: float, old: float) -> float:
        return 2 * max(np.max(np.abs(beta - before) / (np.abs(beta) + np.abs(before) + tolerance)), abs(new - old) / (new + old + tolerance))

    spread: dict[str, float] | None = None
    first_eta, first_fits = eta, dict(fits)
    for _ in range(rounds):
        state = rows.join(eta, ["trait", "sample_idx"])
        if spread is None:
            mu = 1 / (1 + F.exp(-F.col("eta")))
            z = F.col("eta") + (F.col("y") - mu) / (mu * (1 - mu))
            spread = {r["trait"]: r["v"] / (2 * r["k"]) for r in state.groupBy("trait").agg(F.var_samp(z).alias("v"), F.mean("own").alias("k")).collect()}
            fits = {t: (b, spread[t]) for t, (b, _) in fits.items()}
        taus = {t: f[1] for t, f in fits.items()}
        lost = set()
        for t, (m0, m1, m2, trace) in sums_at(state.filter(F.col("trait").isin([t for t in fits if t not in settled])), taus).items():
            cov = np.linalg.inv(m0[:p, :p])
            beta = cov @ m0[:p, p]
            c = np.append(-beta, 1.0)
            score = c @ m1 @ c - (trace - np.trace(cov @ m1[:p, :p]))
            cross = (m1 @ c)[:p]
            step = score / (c @ m2 @ c - cross @ cov @ cross)
            old = taus[t]
            if not np.isfinite(step) or not np.isfinite(beta).all():
                lost.add(t)
                continue
            while old + step < 0 and old >= tolerance:
                step /= 2
            new = max(old + step, 0.0)
            new = 0.0 if new < tolerance else new
            change = change_of(beta, fits[t][0], new, old)
            fits[t] = (beta, new)
            if change < tolerance:
                settled[t] = (beta, cov, old, new)
        fits = {t: f for t, f in fits.items() if t not in lost}
        if len(settled) == len(fits):
            break
        eta = moved(state.filter(F.col("trait").isin(list(fits))), taus, {t: f[0] for t, f in fits.items()})
    missing = sorted(set(first_fits) - set(settled))
    if missing:
        again = F.col("trait").isin(missing)
        found, recovered = _search_logistic(rows.filter(again), first_eta.filter(again), {t: first_fits[t][0] for t in missing}, p, working, sums_at, moved, change_of, tolerance, rounds)
        settled |= found
        eta = eta.filter(~again).unionByName(recovered)

    def precision(key: tuple, own: pd.DataFrame, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        _, w, mu = working(own)
        inverse = np.linalg.inv(np.diag(1 / w) + settled[key[0]][2] * matrix)
        return inverse, inverse @ own[x].to_numpy(float), own["y"].to_numpy(float) - mu, mu

    return _finish(rows.join(eta, ["trait", "sample_idx"]), p, precision, {t: (f[0], f[1], (1.0, f[3])) for t, f in settled.items()}, "binomial")


def _search_logistic(rows: DataFrame, eta: DataFrame, betas: dict[str, np.ndarray], p: int, working: Callable, sums_at: Callable, moved: Callable, change_of: Callable, tolerance: float, rounds: int) -> tuple[dict[str, tuple], DataFrame]:
    """Settled fits (beta, cov, tau, tau) by searching each round's restricted likelihood, and the linear predictors they end with."""
    x = [f"x{i}" for i in range(p)]

    def likelihoods(state: DataFrame, grids: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Restricted log-likelihood (up to a constant) of every trait at every tau of its grid; one pass over the blocks."""

        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            grid = grids[key[0]]
            logs, sums = np.zeros(len(grid)), np.zeros((len(grid), p + 1, p + 1))
            for own, k in _blocks(part):
                z, w, _ = working(own)
                both = np.column_stack([own[x].to_numpy(float), z])
                for i, tau in enumerate(grid):
                    v = np.diag(1 / w) + tau * k
                    logs[i] += np.linalg.slogdet(v)[1]
                    sums[i] += both.T @ np.linalg.solve(v, both)
            return pd.DataFrame({"trait": [key[0]], "sums": [np.concatenate([logs, sums.ravel()]).tolist()]})

        size = SEARCH_POINTS * ((p + 1) ** 2 + 1)
        per_bucket = state.groupBy("trait", "bucket").applyInPandas(run, "trait string, sums array<double>")
        out = {}
        for r in per_bucket.groupBy("trait").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(size))).alias("sums")).collect():  # one row per trait
            logs, m = np.array(r["sums"][:SEARCH_POINTS]), np.array(r["sums"][SEARCH_POINTS:]).reshape(-1, p + 1, p + 1)
            rest = m[:, p, p] - np.einsum("ti,ti->t", m[:, :p, p], np.linalg.solve(m[:, :p, :p], m[:, :p, p, None])[:, :, 0])
            out[r["trait"]] = -0.5 * (logs + np.linalg.slogdet(m[:, :p, :p])[1] + rest)
        return out

    settled: dict[str, tuple] = {}
    taus = {t: 1.0 for t in betas}
    at_zero: set[str] = set()
    for _ in range(2 * rounds):
        todo = [t for t in betas if t not in settled]
        state = rows.join(eta, ["trait", "sample_idx"])
        active = state.filter(F.col("trait").isin(todo))
        best = {t: 0.0 for t in todo}
        ends = {t: np.log(SEARCH) for t in todo if t not in at_zero}
        while ends:
            grids = {t: np.exp(np.linspace(*e, SEARCH_POINTS)) for t, e in ends.items()}
            for t, values in likelihoods(active.filter(F.col("trait").isin(list(ends))), grids).items():
                i = int(np.argmax(values))
                best[t] = float(grids[t][i])
                ends[t] = np.log([grids[t][max(i - 1, 0)], grids[t][min(i + 1, SEARCH_POINTS - 1)]])
            ends = {t: e for t, e in ends.items() if e[1] - e[0] > tolerance}
        for t, (m0, *_) in sums_at(active, taus | best).items():
            cov = np.linalg.inv(m0[:p, :p])
            beta = cov @ m0[:p, p]
            change = change_of(beta, betas[t], best[t], taus[t])
            betas[t], taus[t] = beta, best[t]
            if change < 10 * tolerance:  # as fine as the search
                if best[t] < 1.01 * SEARCH[0] and t not in at_zero:
                    at_zero.add(t)
                else:
                    settled[t] = (beta, cov, best[t], best[t])
        if len(settled) == len(betas):
            return settled, eta
        eta = moved(state, taus, betas)
    raise ArithmeticError(f"no convergence for {sorted(set(betas) - set(settled))}")
