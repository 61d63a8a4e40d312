"""Connected blocks of a sparse symmetric matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .skew import skew_join


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u > v) rewired to the smallest neighbour of each vertex: for neighbours above it (large) or not above it (small)."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
    joined = skew_join(edges, least, ["u"])
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
    return moved.filter("u <> v").distinct()


def matrix_blocks(entries: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """(index, block) of every row with an entry off the diagonal; block is the smallest index connected with it.

    Indices are bigint; null ones and diagonal entries are ignored, repeats and direction do not
    matter. Alternates large and small stars until every vertex hangs on its block's smallest one;
    each is a join with a minimum per vertex, so no task holds a block.
    """
    ends = entries.select(F.col(i).cast("bigint").alias("a"), F.col(j).cast("bigint").alias("b")).filter("a <> b")
    edges = stored(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "blocks")
    before = None
    while True:
        large = stored(_star(edges, True), "blocks")
        small = stored(_star(large, False), "blocks")
        for old in (edges, large):
            discard(old)
        # The different edges are told by their number and the sum of their hashes.
        edges, after = small, tuple(small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())  # one row
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("index"), F.col("v").alias("block")).unionByName(edges.select(F.col("v").alias("index"), F.col("v").alias("block")).distinct())
