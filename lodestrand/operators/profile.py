"""Quality profile of every column of every load, with changes against the cohort's previous load.

Rows unpivot into (cell, value) counts, where a cell is one column of one load; equal values merge
before any shuffle, so repeated values cost one row. The counts are range-sorted once by column,
cohort and value. Counts per cell and partition, summed over the partitions before, turn sorted
positions inside a partition into exact ranks: quantiles, distinct counts and, with the curves of
neighbouring loads merged, exact Kolmogorov-Smirnov distances. No task holds a whole column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, stored
from .rejects import is_missing, number, trimmed

CELL = ("table_name", "cohort", "load_id", "column_name")
SERIES = ("table_name", "cohort", "column_name")

# Fixed limits of the findings.
NULL_RATE_CHANGE = 0.15
DISTINCT_SHARE = 0.5
SHIFT = 0.3


def value_counts(df: DataFrame, table_name: str, columns: Sequence[str]) -> DataFrame:
    """(cell, kind, value, n): how often each value occurs; kind is missing, bad or number, value set for numbers.

    Text columns hold numbers as text; NaN is missing and an infinity bad in numeric ones. Exact
    repeats of a row count once. A null cohort counts as the empty one; rows without load_id are
    left out. -0.0 is 0.0.
    """
    types = dict(df.dtypes)
    columns = [c for c in columns if c in types]
    rows = df.filter("load_id is not null").select("row_id", F.coalesce("cohort", F.lit("")).alias("cohort"), "load_id", *columns).distinct()
    out = None
    for text in (True, False):
        names = [c for c in columns if (types[c] == "string") == text]
        if not names:
            continue
        kind_of_raw = F.col("raw") if text else F.col("raw").cast("double")
        counted = rows.unpivot(["cohort", "load_id"], [F.col(c) if text else F.col(c).cast("double").alias(c) for c in names], "column_name", "raw")
        counted = counted.groupBy("cohort", "load_id", "column_name", kind_of_raw.alias("raw")).agg(F.count(F.lit(1)).alias("n"))
        if text:
            clean = trimmed(F.col("raw"))
            value, missing = number(clean), F.col("raw").isNull() | is_missing(clean)
        else:
            missing = F.col("raw").isNull() | F.isnan("raw")
            value = F.when(~missing & (F.abs("raw") < float("inf")), F.col("raw"))
        kind = F.when(missing, "missing").when(value.isNull(), "bad").otherwise("number")
        value = value + F.lit(0.0)
        part = counted.select(F.lit(table_name).alias("table_name"), "cohort", "load_id", "column_name", kind.alias("kind"), value.alias("value"), "n")
        if text:
            part = part.groupBy(*CELL, "kind", "value").agg(F.sum("n").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def sorted_counts(counts: DataFrame) -> DataFrame:
    """The counts range-sorted by column, cohort and value, with the number of their sorted partition, as a stored table.

    Equal values of a series share a partition (one number row per load), so curves of neighbouring
    loads step together there.
    """
    spread = counts.repartitionByRange(*SERIES, "value").withColumn("part", F.spark_partition_id())
    return stored(spread, "value_counts")


def cells(counts: DataFrame) -> DataFrame:
    """One row per cell with its counts and range, and those of the cohort's previous load (prev_*, null for first loads)."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    per_cell = counts.groupBy(*CELL).agg(
        F.sum("n").alias("rows"), of("missing").alias("missing"), of("bad").alias("bad"), of("number").alias("numbers"), F.count("value").alias("distinct"), F.min("value").alias("least"), F.max("value").alias("greatest")
    )
    before = Window.partitionBy(*SERIES).orderBy("load_id")
    return per_cell.select("*", *(F.lag(c).over(before).alias(f"prev_{c}") for c in ("load_id", "rows", "missing", "numbers", "distinct")), F.lead("load_id").over(before).alias("next_load_id"))


def _before(parts: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Per cell and partition, what the cell has in earlier partitions."""
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums))


def quantiles(counts: DataFrame, per_cell: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Per cell the exact discrete quantiles q<percent> of its numbers (null without any)."""
    numbers = counts.filter("kind = 'number'")
    parts = numbers.groupBy(*CELL, "part").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy(*CELL, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    sizes = per_cell.select(*CELL, "numbers")
    ranked = (
        numbers.withColumn("upto", F.sum("n").over(inside))
        .join(broadcast_if_small(_before(parts, CELL, ["n"]).join(sizes, list(CELL))), [*CELL, "part"])
        .withColumn("upto", F.col("upto") + F.col("n_before"))
    )

    def pick(p: float) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("numbers")))
        return F.max(F.when((rank <= F.col("upto")) & (rank > F.col("upto") - F.col("n")), F.col("value"))).alias(f"q{round(100 * p)}")

    return ranked.groupBy(*CELL).agg(*(pick(p) for p in probabilities))


def distances(counts: DataFrame, per_cell: DataFrame) -> DataFrame:
    """Per cell the Kolmogorov-Smirnov distance to the previous load's numbers (cells where both have numbers)."""
    pairs = per_cell.select(*CELL, "numbers", "prev_numbers", "next_load_id")
    own = F.struct(F.col("load_id").alias("load_id"), F.col("n").alias("cur"), F.lit(0).cast("bigint").alias("prev"))
    as_previous = F.struct(F.col("next_load_id").alias("load_id"), F.lit(0).cast("bigint").alias("cur"), F.col("n").alias("prev"))
    following = broadcast_if_small(per_cell.select(*CELL, "next_load_id"))
    curves = (
        counts.filter("kind = 'number'")
        .join(following, list(CELL))
        .select("table_name", "cohort", "column_name", "part", "value", F.explode(F.array(own, as_previous)).alias("x"))
        .select("table_name", "cohort", "x.load_id", "column_name", "part", "value", "x.cur", "x.prev")
        .filter("load_id is not null")
    )
    parts = curves.groupBy(*CELL, "part").agg(F.sum("cur").alias("cur"), F.sum("prev").alias("prev"))
    steps = broadcast_if_small(_before(parts, CELL, ["cur", "prev"]).join(pairs, list(CELL)).filter("numbers > 0 and prev_numbers > 0").drop("next_load_id"))
    upto = Window.partitionBy(*CELL, "part").orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    gap = F.abs((F.col("cur_before") + F.col("cur_upto")) / F.col("numbers") - (F.col("prev_before") + F.col("prev_upto")) / F.col("prev_numbers"))
    return (
        curves.withColumn("cur_upto", F.sum("cur").over(upto))
        .withColumn("prev_upto", F.sum("prev").over(upto))
        .join(steps, [*CELL, "part"])
        .groupBy(*CELL)
        .agg(F.max(gap).alias("distance"))
    )


def _counts(tables: dict[str, DataFrame], dictionary: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        # The dictionary has one row per column of the schema.
        columns = [r["column_name"] for r in dictionary.filter(F.col("table_name") == name).select("column_name").distinct().orderBy("column_name").collect()]
        counts = value_counts(df, name, columns)
        out = counts if out is None else out.unionByName(counts)
    return sorted_counts(out)


def profile(tables: dict[str, DataFrame], dictionary: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profile of every dictionary column of every load: counts, range, quantiles and distance to the previous load."""
    counts = _counts(tables, dictionary)
    per_cell = cut(cells(counts))
    return (
        per_cell.drop("next_load_id")
        .join(quantiles(counts, per_cell, probabilities), list(CELL), "left")
        .join(distances(counts, per_cell), list(CELL), "left")
    )


def findings(tables: dict[str, DataFrame], dictionary: DataFrame) -> DataFrame:
    """table_name, load_id, column_name, finding of every conspicuous cell."""
    counts = _counts(tables, dictionary)
    per_cell = cut(cells(counts))
    limits = dictionary.select("table_name", "column_name", "min_value", "max_value").distinct()
    judged = per_cell.join(limits, ["table_name", "column_name"]).join(distances(counts, per_cell), list(CELL), "left")
    share = F.col("missing") / F.col("rows")
    previous = F.col("prev_missing") / F.col("prev_rows")
    rules = {
        "pattern": F.col("bad") > 0,
        "range": (F.col("least") < F.col("min_value")) | (F.col("greatest") > F.col("max_value")),
        "constant": F.col("distinct") == 1,
        "distinct": F.col("distinct") < DISTINCT_SHARE * F.col("prev_distinct"),
        "null_rate": F.abs(share - previous) > NULL_RATE_CHANGE,
        "shift": F.col("distance") > SHIFT,
    }
    found = F.filter(F.array(*(F.when(rule, name) for name, rule in rules.items())), lambda x: x.isNotNull())
    return judged.select("table_name", "load_id", "column_name", F.explode(found).alias("finding")).distinct()
