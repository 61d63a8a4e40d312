"""Null models of many traits at once, fitted from aggregated normal equations.

A design has trait, sample_idx, y and x0 .. x<p-1>. A fitted model is two tables: one row per trait
and sample (resid, w, wx0 .. and mu for binary traits) and one row per trait (n, cov and sums).
Sums over samples are taken by Spark; the driver only solves p x p systems, one per trait.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stored
from .ranking import inverse_normal


@dataclass
class NullModel:
    """``samples``: trait, sample_idx, resid, w, w1, mu, x*, wx*; ``models``: trait, family, n, beta, cov, sigma2, r0, w0, xw0.

    With a precision matrix S of the samples, w is its diagonal, w1 its row sums, wx its product with
    the design, and ``pairs`` (trait, i, j, value) its other entries; independent samples have none.
    """

    samples: DataFrame
    models: DataFrame
    p: int
    pairs: DataFrame | None = None

    def union(self, other: NullModel) -> NullModel:
        pairs = self.pairs if other.pairs is None else other.pairs if self.pairs is None else self.pairs.unionByName(other.pairs)
        return NullModel(self.samples.unionByName(other.samples), self.models.drop("tau").unionByName(other.models.drop("tau")), self.p, pairs)


def _x(p: int) -> list[str]:
    return [f"x{i}" for i in range(p)]


def _moments(rows: DataFrame, p: int, weight: Column, target: Column, *more: Column) -> DataFrame:
    """Per trait: n, xtx (upper triangle), xty and further aggregates, in one pass."""
    xtx = [F.sum(weight * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(p) for j in range(i, p)]
    xty = [F.sum(weight * F.col(f"x{i}") * target) for i in range(p)]
    return rows.groupBy("trait").agg(F.count(F.lit(1)).alias("n"), F.array(*xtx).alias("xtx"), F.array(*xty).alias("xty"), *more)


def _square(upper, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = upper
    return out + np.triu(out, 1).T


def _dot(p: int, factors: str) -> Column:
    return sum((F.col(f"x{i}") * F.col(factors)[i] for i in range(1, p)), F.col("x0") * F.col(factors)[0])


def fit_linear(design: DataFrame, p: int) -> NullModel:
    """Ordinary least squares: resid = (y - fit) / sigma2 and w = 1 / sigma2. A singular design or n <= p is an error."""
    design = stored(design.select("trait", "sample_idx", "y", *_x(p)), "design")
    sums = _moments(design, p, F.lit(1.0), F.col("y"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                xtx = _square(r.xtx, p)
                if r.n <= p or np.linalg.matrix_rank(xtx) < p:
                    raise ValueError(f"design of {r.trait} is singular or too short")
                rows.append((r.trait, np.linalg.solve(xtx, r.xty).tolist(), np.linalg.inv(xtx).ravel().tolist(), r.n))
            yield pd.DataFrame(rows, columns=["trait", "beta", "inverse", "n"])

    fits = sums.mapInPandas(solve, "trait string, beta array<double>, inverse array<double>, n bigint")
    fitted = design.join(broadcast_if_small(stored(fits, "fits")), "trait").withColumn("raw", F.col("y") - _dot(p, "beta"))
    scale = fitted.groupBy("trait").agg((F.sum(F.col("raw") * F.col("raw")) / (F.first("n") - p)).alias("sigma2"))
    rows = fitted.join(broadcast_if_small(scale), "trait").withColumn("w", 1 / F.col("sigma2")).withColumn("resid", F.col("raw") / F.col("sigma2")).withColumn("mu", F.lit(None).cast("double"))
    samples = stored(_sample_columns(rows, p), "null_samples")
    models = fits.join(scale, "trait").select("trait", F.lit("gaussian").alias("family"), "beta", F.transform("inverse", lambda v: v * F.col("sigma2")).alias("cov"), "sigma2")
    return NullModel(samples, stored(_with_sums(models, samples, p), "null_models"), p)


def fit_logistic(design: DataFrame, p: int, rounds: int = 100, tolerance: float = 1e-8) -> NullModel:
    """Iteratively reweighted least squares of all traits together; one aggregation of the design per round.

    Values other than 0 and 1, separated traits and missing convergence are errors.
    """
    rows = stored(design.select("trait", "sample_idx", "y", *_x(p)), "design")
    if not rows.filter(~F.col("y").isin(0.0, 1.0)).isEmpty():
        raise ValueError("binary traits have values other than 0 and 1")
    spark = design.sparkSession
    start = F.log((F.col("y") + 0.5) / (1.5 - F.col("y")))
    state: dict[str, np.ndarray] = {}
    loss: dict[str, float] = {}
    open_traits: set[str] | None = None
    eta = start
    for _ in range(rounds):
        current = rows
        if state:
            table = spark.createDataFrame([(t, b.tolist()) for t, b in state.items() if t in open_traits], "trait string, beta array<double>")
            current, eta = rows.join(F.broadcast(table), "trait"), _dot(p, "beta")
        current = current.withColumn("eta", eta).withColumn("mu", 1 / (1 + F.exp(-F.col("eta")))).withColumn("v", F.greatest(F.col("mu") * (1 - F.col("mu")), F.lit(1e-12)))
        deviance = -2 * F.sum(F.when(F.col("y") == 1, -F.log1p(F.exp(-F.col("eta")))).otherwise(-F.log1p(F.exp(F.col("eta")))))
        working = F.col("eta") + (F.col("y") - F.col("mu")) / F.col("v")
        got = _moments(current, p, F.col("v"), working, deviance.alias("loss")).collect()  # one row per trait
        if open_traits is None:
            open_traits = {r["trait"] for r in got}
        for r in got:
            t = r["trait"]
            settled = t in loss and abs(r["loss"] - loss[t]) < tolerance * (0.05 + abs(r["loss"]))
            if r["loss"] < 1e-6 * r["n"]:
                raise ValueError(f"{t} is separated by its covariates")
            if settled:  # the step that is left refines the estimate once more
                open_traits.discard(t)
            step = np.linalg.solve(_square(r["xtx"], p), np.array(r["xty"]))
            if t in loss and r["loss"] > loss[t] + 1e-10 and t in state:
                step = (step + state[t]) / 2
            loss[t], state[t] = r["loss"], step
        if not open_traits:
            break
    else:
        raise ValueError(f"no convergence for {sorted(open_traits)}")
    table = spark.createDataFrame([(t, b.tolist()) for t, b in state.items()], "trait string, beta array<double>")
    fitted = rows.join(F.broadcast(table), "trait").withColumn("mu", 1 / (1 + F.exp(-_dot(p, "beta"))))
    fitted = fitted.withColumn("w", F.col("mu") * (1 - F.col("mu"))).withColumn("resid", F.col("y") - F.col("mu"))
    samples = stored(_sample_columns(fitted, p), "null_samples")
    inverse = _inverses(_moments(samples, p, F.col("w"), F.lit(0.0)), p)
    models = table.join(inverse, "trait").select("trait", F.lit("binomial").alias("family"), "beta", F.col("inverse").alias("cov"), F.lit(1.0).alias("sigma2"))
    return NullModel(samples, stored(_with_sums(models, samples, p), "null_models"), p)


def _inverses(sums: DataFrame, p: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"trait": batch["trait"], "inverse": [np.linalg.inv(_square(u, p)).ravel().tolist() for u in batch["xtx"]]})

    return sums.mapInPandas(run, "trait string, inverse array<double>")


def _sample_columns(rows: DataFrame, p: int) -> DataFrame:
    return rows.select("trait", "sample_idx", "resid", "w", F.col("w").alias("w1"), "mu", *_x(p), *((F.col("w") * F.col(f"x{i}")).alias(f"wx{i}") for i in range(p)))


def _with_sums(models: DataFrame, samples: DataFrame, p: int) -> DataFrame:
    sums = samples.groupBy("trait").agg(F.count(F.lit(1)).alias("n"), F.sum("resid").alias("r0"), F.sum("w").alias("w0"), F.array(*(F.sum(f"wx{i}") for i in range(p))).alias("xw0"))
    return models.join(sums, "trait")


def residual_inverse_normal(design: DataFrame, p: int) -> DataFrame:
    """The design with y replaced by the inverse normal values of its least-squares residuals, times y's standard deviation."""
    model = fit_linear(design, p)
    sigma = model.models.select("trait", "sigma2")
    raw = model.samples.join(broadcast_if_small(sigma), "trait").select("trait", "sample_idx", (F.col("resid") * F.col("sigma2")).alias("raw"))
    spread = design.groupBy("trait").agg(F.stddev_samp("y").alias("spread"))
    values = inverse_normal(raw, ["trait"], "raw").join(broadcast_if_small(spread), "trait")
    return design.drop("y").join(values.select("trait", "sample_idx", (F.col("rint") * F.col("spread")).alias("y")), ["trait", "sample_idx"])


def standardised(design: DataFrame, names: list[str]) -> DataFrame:
    """Columns centred and scaled per trait (sample standard deviation); constant columns become 0."""
    stats = design.groupBy("trait").agg(*(f(c).alias(f"{c}_{k}") for c in names for k, f in (("mean", F.mean), ("sd", F.stddev_samp))))
    joined = design.join(broadcast_if_small(stats), "trait")
    scaled = {c: F.when(F.col(f"{c}_sd") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")).otherwise(0.0) for c in names}
    return joined.withColumns(scaled).select(design.columns)


def independent_columns(design: DataFrame, names: list[str], tolerance: float = 1e-10) -> dict[str, list[str]]:
    """Per trait the columns that no earlier ones (nor the intercept) determine, decided on the small Gram matrix."""
    rows = standardised(design, names).withColumns({f"x{i}": F.col(c) for i, c in enumerate(names)})
    kept = {}
    for r in _moments(rows, len(names), F.lit(1.0), F.lit(0.0)).collect():  # one row per trait
        gram = _square(r["xtx"], len(names)) / r["n"]
        chosen: list[int] = []
        for i in range(len(names)):
            rest = gram[i, i]
            if chosen:
                inner = gram[np.ix_(chosen, chosen)]
                rest -= gram[i, chosen] @ np.linalg.solve(inner, gram[chosen, i])
            if rest > tolerance:
                chosen.append(i)
        kept[r["trait"]] = [names[i] for i in chosen]
    return kept


def needs_intercept(design: DataFrame, names: list[str]) -> DataFrame:
    """(trait, needs_intercept): whether no column is 1 everywhere."""
    all_ones = [(F.min(c) == 1) & (F.max(c) == 1) for c in names]
    any_ones = all_ones[0]
    for c in all_ones[1:]:
        any_ones = any_ones | c
    return design.groupBy("trait").agg((~any_ones).alias("needs_intercept"))


def save_model(model: NullModel, path: str) -> None:
    """Write a fitted model as Parquet tables."""
    model.samples.write.parquet(f"{path}/samples")
    model.models.write.parquet(f"{path}/models")
    if model.pairs is not None:
        model.pairs.write.parquet(f"{path}/pairs")


def load_model(spark: SparkSession, path: str) -> NullModel:
    """A saved model; the number of design columns is that of its samples."""
    samples = spark.read.parquet(f"{path}/samples")
    try:
        pairs = spark.read.parquet(f"{path}/pairs")
    except AnalysisException:
        pairs = None
    return NullModel(samples, spark.read.parquet(f"{path}/models"), sum(c.startswith("wx") for c in samples.columns), pairs)
