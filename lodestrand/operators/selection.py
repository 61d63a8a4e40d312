"""Exact order statistics per key when a few keys hold most rows.

No task ever holds the values of one key. Each round counts the rows of every open interval in at
most ``bins`` bins (counts, minima and maxima merge on the map side), keeps the bin that holds the
wanted rank, and narrows the interval to that bin's own smallest and largest value. An interval
whose ends meet is the answer; a round divides the width of the others by ``bins``. The merged
counts of the first round also tell how many rows a key has, and so which ranks do not exist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .skew import skew_join


def select_ranks(rows: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, bins: int = 256) -> DataFrame:
    """The value at each wanted rank of each key: keys, rank, n (rows of the key), value.

    ``rows`` has one row per item (repeats count), ``ranks`` has keys and ``rank`` (bigint from 1,
    several per key allowed, repeats ignored). A rank below 1 or beyond the number of rows lies in no
    bin and gives no row, nor do keys without rows. Rows with a null key or value are ignored;
    NaN sorts above all numbers. Other columns of ``rows`` are not read. ``rows`` is read once per
    round and should be a stored table.
    """
    keys = list(keys)
    data = rows.select(*keys, F.col(value).alias("_v")).dropna()
    ends = data.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).first()  # one row
    wanted = ranks.select(*keys, F.col("rank").cast("bigint").alias("rank")).dropna().distinct()
    kind = data.schema["_v"].dataType
    whole = wanted.select("*", F.lit(None).cast("bigint").alias("n"), F.lit(ends["_lo"]).cast(kind).alias("_lo"), F.lit(ends["_hi"]).cast(kind).alias("_hi"), F.col("rank").alias("_need"))
    state = cut(_refine(data, keys, cut(whole), F.lit(True), bins))
    while not state.filter("_lo < _hi").isEmpty():
        state = cut(_refine(data, keys, state, F.col("_lo") < F.col("_hi"), bins))
    return state.select(*keys, "rank", "n", F.col("_lo").alias("value"))


def _refine(data: DataFrame, keys: list[str], state: DataFrame, unresolved: Column, bins: int) -> DataFrame:
    """The state with the intervals of ``unresolved`` rows narrowed to the bin of their rank; those without such a bin drop out."""
    open_ = state.filter(unresolved)
    intervals = open_.select(*keys, "_lo", "_hi").distinct()
    above = lambda c: F.coalesce(F.try_subtract(F.col(c), F.col("_lo")).cast("double"), F.col(c).cast("double") - F.col("_lo").cast("double"))
    width = above("_hi") / F.lit(bins)
    # An interval too narrow or too wide for doubles is split into its lower end and the rest.
    usable = (width > 0) & (width < F.lit(float("inf")))
    place = F.floor(above("_v") / F.when(usable, width))
    cell = F.when(usable, F.least(place, F.lit(bins - 1))).otherwise(F.when(F.col("_v") > F.col("_lo"), 1).otherwise(0))
    counted = (
        skew_join(data, intervals, keys)
        .filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        .groupBy(*keys, "_lo", "_hi", cell.alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    )
    interval = Window.partitionBy(*keys, "_lo", "_hi")
    upto = interval.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    curve = counted.withColumn("_upto", F.sum("_in").over(upto)).withColumn("_all", F.sum("_in").over(interval))
    narrowed = (
        open_.join(curve, [*keys, "_lo", "_hi"])
        .filter((F.col("_need") <= F.col("_upto")) & (F.col("_need") > F.col("_upto") - F.col("_in")))
        .select(*keys, "rank", F.coalesce("n", "_all").alias("n"), F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), (F.col("_need") - F.col("_upto") + F.col("_in")).alias("_need"))
    )
    return state.filter(~unresolved).select(narrowed.columns).unionByName(narrowed)


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Discrete quantiles per key: keys, probability, n, value (the smallest value with that share of rows at or below).

    Nulls, empty tables and repeats as in ``select_ranks``.
    """
    keys = list(keys)
    sizes = rows.select(*keys, value).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    wanted = sizes.select(*keys, "_n", F.explode(F.array(*(F.lit(float(p)) for p in probabilities))).alias("probability")).withColumn(
        "rank", F.greatest(F.lit(1), F.ceil(F.col("probability") * F.col("_n"))).cast("bigint")
    )
    found = select_ranks(rows, keys, value, wanted)
    return wanted.drop("_n").join(found, [*keys, "rank"]).select(*keys, "probability", "n", "value")


def different_variants(assignments: DataFrame, genes: DataFrame) -> DataFrame:
    """One row (run_id, hgnc_symbol, pos, variant) for each different passing variant of a known gene, over all categories.

    Distinct runs on the whole (run, gene, variant) key, so a hot gene spreads over all tasks.
    Rows with a null run or symbol, or another qc than 'PASS', are left out; null variant parts
    are values of their own. ``variant`` is the position, or -1 where it is null, so that all of them can be ranked.
    """
    known = genes.select("hgnc_symbol").dropna().distinct()
    passing = assignments.filter("qc = 'PASS' and run_id is not null").select("run_id", "hgnc_symbol", "pos", "ref_allele", "alt_allele")
    return skew_join(passing, known, ["hgnc_symbol"], "left_semi").distinct().select("run_id", "hgnc_symbol", "pos", F.coalesce("pos", F.lit(-1)).alias("variant"))
