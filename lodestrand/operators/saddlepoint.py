"""Saddlepoint tails of score tests of binary traits, for all chosen tests together.

The cumulants of a test are sums over all samples of its trait. Samples that do not carry the
burden differ only by their mean and design, so equal ones are counted once; these rows lie in blocks, and
every block meets the open tests in batches of bounded size. Carriers are corrected by plain
expressions. A round is one aggregation: it moves all tests one Newton step, or narrows
the bracket of those that need a bisection. Neither samples nor tests pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.tails import erfc
from ..session import stored
from .null_models import NullModel
from .skew import skew_join

#: Different (mean, design) rows of a block, and tests of a batch, about.
BLOCK_ROWS = 8_192
BATCH_TESTS = 128
#: Points of a bracket that one round tries.
BISECTION_POINTS = 63
NEWTON_ROUNDS = 12

# Fixed values of the method: the bracket of a bisection, the steps beyond which Newton's are given
# up, and the smallest saddlepoint at which the tail formula holds.
BRACKET, FARTHEST, NEAREST = 100.0, 1e4, 1e-4

_SUMS = "test_id bigint, side int, t double, k0 double, k1 double, k2 double"


def _blocks(null: NullModel, p: int) -> DataFrame:
    """trait, block, rows (mu, many, x) of the different (mu, design) rows of binary traits."""
    x = [f"x{i}" for i in range(p)]
    counted = stored(null.samples.filter("mu is not null").groupBy("trait", "mu", *x).agg(F.count(F.lit(1)).cast("double").alias("many")), "patterns")
    blocks = max(1, math.ceil(counted._stored_rows / BLOCK_ROWS))
    block = F.pmod(F.xxhash64("mu", *x), F.lit(blocks)).alias("block")
    return stored(counted.groupBy("trait", block).agg(F.collect_list(F.struct("mu", "many", *x)).alias("rows")), "blocks")


def _block_sums(p: int):
    x = [f"x{i}" for i in range(p)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, tests in zip(batch["rows"], batch["tests"], strict=True):
                mu, many = (np.array([r[c] for r in rows], float)[:, None] for c in ("mu", "many"))
                design = np.array([[r[c] for c in x] for r in rows], float)
                t = np.array([r["t"] for r in tests], float)
                g = np.array([r["base"] for r in tests], float) - design @ np.array([r["factor"] for r in tests], float).T
                gt = np.clip(g * t, -700, 700)
                share = mu / (mu + (1 - mu) * np.exp(-gt))
                sums = (np.log1p(mu * np.expm1(gt)) - gt * mu, g * (share - mu), g * g * share * (1 - share))
                yield pd.DataFrame({"test_id": [r["test_id"] for r in tests], "side": [r["side"] for r in tests], "t": t, **{f"k{i}": (many * s).sum(axis=0) for i, s in enumerate(sums)}})

    return run


def _cumulants(g: Column, mu: Column, t: Column) -> tuple[Column, Column, Column]:
    gt = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), g * t))
    share = mu / (mu + (1 - mu) * F.exp(-gt))
    return F.log1p(mu * F.expm1(gt)) - gt * mu, g * (share - mu), g * g * share * (1 - share)


def _sums(points: DataFrame, n_points: int, blocks: DataFrame, carriers: DataFrame, p: int) -> DataFrame:
    """k0, k1, k2: the cumulant and its first two derivatives at every one of ``n_points`` points (test_id, side, t, trait, base, factor)."""
    batch = F.pmod(F.xxhash64("test_id", "side", "t"), F.lit(max(1, math.ceil(n_points / BATCH_TESTS)))).alias("batch")
    batches = points.groupBy("trait", batch).agg(F.collect_list(F.struct("test_id", "side", "t", "base", "factor")).alias("tests"))
    others = batches.join(blocks, "trait").repartition("trait", "batch", "block").select("rows", "tests").mapInPandas(_block_sums(p), _SUMS)
    own = skew_join(carriers, points.select("test_id", "side", "t"), ["test_id"])
    own = own.withColumn("with", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(_cumulants(F.col("g1"), F.col("mu"), F.col("t"))))))
    own = own.withColumn("without", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(_cumulants(F.col("g0"), F.col("mu"), F.col("t"))))))
    changed = own.groupBy("test_id", "side", "t").agg(*(F.sum(F.col(f"with.k{i}") - F.col(f"without.k{i}")).alias(f"k{i}") for i in range(3)))
    return others.unionByName(changed).groupBy("test_id", "side", "t").agg(*(F.sum(f"k{i}").alias(f"k{i}") for i in range(3)))


def _tail(rows: DataFrame) -> DataFrame:
    """Adds tail: the probability beyond q on its side at the saddlepoint t, or null where the formula does not hold."""
    squared = 2 * (F.col("t") * F.col("q") - F.col("k0"))
    holds = (F.abs("t") >= NEAREST) & (squared > 0) & (F.col("k2") > 0)
    rows = rows.withColumn("_w", F.when(holds, F.signum("t") * F.sqrt(squared))).withColumn("_ratio", F.col("t") * F.sqrt("k2") / F.col("_w"))
    rows = rows.withColumn("_x", F.when(F.col("_ratio") > 0, (F.col("_w") + F.log("_ratio") / F.col("_w")) / math.sqrt(2)))
    rows = rows.withColumn("_upper", erfc(F.col("_x")) / 2)
    return rows.withColumn("tail", F.when(F.col("q") > 0, F.col("_upper")).otherwise(1 - F.col("_upper"))).drop("_w", "_ratio", "_x", "_upper")


def saddlepoint_p(tests: DataFrame, carriers: DataFrame, null: NullModel, keys: Sequence[str], tolerance: float = 2.0**-13) -> DataFrame:
    """``keys`` and p_spa of every test: both tails of its score under the fitted means; 1 where a tail has no saddlepoint.

    ``tests`` has trait, the keys (which tell tests apart), score, base (the burden of who does not
    carry) and cross (its product with the precision matrix and the design), ``carriers`` trait,
    the keys, sample_idx and e, what a carrier's burden differs from base. A score of 0 gives 1.
    """
    p, keys = null.p, list(keys)
    x = [f"x{i}" for i in range(p)]
    factor = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.aggregate(F.zip_with(F.slice("cov", i * p + 1, p), F.col("cross"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    named = stored(tests.join(null.models.select("trait", "cov"), "trait").select(*dict.fromkeys(["trait", *keys]), "score", "base", factor.alias("factor"), F.monotonically_increasing_id().alias("test_id")), "spa_tests")
    if not named._stored_rows:
        return named.select(*keys, F.lit(None).cast("double").alias("p_spa"))
    blocks = _blocks(null, p)
    g0 = F.col("base") - sum((F.col(c) * F.col("factor")[i] for i, c in enumerate(x)), F.lit(0.0))
    own = carriers.join(named, list(dict.fromkeys(["trait", *keys]))).join(null.samples.select("trait", "sample_idx", "mu", *x), ["trait", "sample_idx"])
    own = stored(own.select("test_id", "mu", g0.alias("g0"), (g0 + F.col("e")).alias("g1")), "spa_carriers")

    state = stored(
        named.select("test_id", "trait", "base", "factor", F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"), (F.abs("score")).alias("q"))
        .withColumn("q", F.col("q") * F.col("side"))
        .select("*", F.lit(0.0).alias("t"), F.lit("newton").alias("stage"), F.lit(-BRACKET).alias("low"), F.lit(BRACKET).alias("high"), F.lit(None).cast("double").alias("tail")),
        "spa_state",
    )
    finished: list[DataFrame] = []
    step, n_points = 0, state._stored_rows
    while n_points:
        # What is open: Newton's point, the last point of a settled search, or the points within a bracket.
        inner = F.transform(F.sequence(F.lit(1), F.lit(BISECTION_POINTS)), lambda i: F.col("low") + (F.col("high") - F.col("low")) * i / (BISECTION_POINTS + 1))
        tried = F.when(F.col("stage") == "bracket", inner).otherwise(F.array("t"))
        points = state.select("test_id", "side", "trait", "base", "factor", F.explode(tried).alias("t"))
        at = _sums(points, n_points, blocks, own, p).withColumnRenamed("t", "at")
        per_test = at.groupBy("test_id", "side").agg(F.sort_array(F.collect_list(F.struct("at", "k0", "k1", "k2"))).alias("points"))  # at most BISECTION_POINTS
        seen = state.join(per_test, ["test_id", "side"])
        one = F.col("points")[0]
        move = (F.col("q") - one["k1"]) / F.when(one["k2"] > 0, one["k2"])
        below = F.array_max(F.transform(F.filter("points", lambda r: r["k1"] <= F.col("q")), lambda r: r["at"]))
        above = F.array_min(F.transform(F.filter("points", lambda r: r["k1"] > F.col("q")), lambda r: r["at"]))
        newton, bracket = F.col("stage") == "newton", F.col("stage") == "bracket"
        lost = newton & (move.isNull() | F.isnan(move) | (F.abs(F.col("t") + move) > FARTHEST) | F.lit(step >= NEWTON_ROUNDS))
        low, high = F.coalesce(below, F.col("low")), F.coalesce(above, F.col("high"))
        seen = _tail(seen.withColumns({"k0": one["k0"], "k2": one["k2"], "move": move, "lost": lost, "new_low": low, "new_high": high}))
        failed = F.col("tail").isNull() | (F.col("tail") == 1.0)
        stage = (
            F.when(newton, F.when(F.col("lost"), "bracket").when(F.abs("move") < tolerance, "settled").otherwise("newton"))
            .when(bracket, F.when(F.col("new_high") - F.col("new_low") <= tolerance, "last").otherwise("bracket"))
            .when((F.col("stage") == "settled") & failed, "bracket")
            .otherwise("done")
        )
        t = F.when(newton & ~F.col("lost"), F.col("t") + F.col("move")).when(bracket, (F.col("new_low") + F.col("new_high")) / 2).otherwise(F.col("t"))
        fresh = seen.select("test_id", "trait", "base", "factor", "side", "q", t.alias("t"), stage.alias("stage"), F.when(bracket, F.col("new_low")).otherwise(F.col("low")).alias("low"), F.when(bracket, F.col("new_high")).otherwise(F.col("high")).alias("high"), "tail")
        counted = Observation()
        open_points = F.sum(F.when(F.col("stage") == "done", 0).when(F.col("stage") == "bracket", BISECTION_POINTS).otherwise(1))
        fresh = stored(fresh.observe(counted, open_points.alias("open")), "spa_state")
        finished.append(fresh.filter("stage = 'done'").select("test_id", "tail"))
        state, n_points = fresh.filter("stage <> 'done'"), counted.get["open"] or 0
        step += 1
    tails = finished[0]
    for more in finished[1:]:
        tails = tails.unionByName(more)
    good = F.when(F.col("tail") < 1, F.col("tail"))
    both = tails.groupBy("test_id").agg(F.when(F.count(good) == 2, F.least(F.lit(1.0), F.sum(good))).otherwise(1.0).alias("p_spa"))
    return named.join(both, "test_id").select(*keys, F.when(F.col("score") == 0, 1.0).otherwise(F.col("p_spa")).alias("p_spa"))
