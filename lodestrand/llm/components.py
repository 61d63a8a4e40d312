"""Groups of records linked directly or through others.

Edges are range-sorted by their smaller end, so that neighbours meet in one partition and a hub is
split by its other ends. Every partition runs union-find and keeps only a spanning forest. A vertex
that lies in several forests joins the one whose root comes first in a random order, roots are
followed once more, and what still connects different parents goes up to the next, smaller level of
partitions, until one bounded partition holds the rest. Labels then pass back down the levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from ..session import discard, stored

#: Edges that one partition merges at most.
PARTITION_EDGES = 500_000
#: Partitions of one level whose forests meet in one partition of the next, where their size allows it.
FAN_IN = 8


def union_find(u: np.ndarray, v: np.ndarray, u_turn: np.ndarray, v_turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges, and the vertex of the smallest turn in each one's component."""
    names, first, ends = np.unique(np.concatenate([u, v]), return_index=True, return_inverse=True)
    by_turn = np.argsort(np.concatenate([u_turn, v_turn])[first], kind="stable")
    place = np.empty_like(by_turn)
    place[by_turn] = np.arange(len(by_turn))
    a, b = place[ends[: len(u)]], place[ends[len(u) :]]
    root = np.arange(len(names))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return names, names[by_turn[root[place]]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    if parts:
        columns = [np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in union_find(*columns)], names=["vertex", "root"])


def _turn(vertex: str, level: int) -> Column:
    """The random order of vertices on a level."""
    return F.xxhash64(vertex, F.lit(level))


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", partition_edges: int = PARTITION_EDGES) -> DataFrame:
    """(vertex, group) for every vertex with an edge to another one; group is its component's smallest vertex.

    Ends are bigint. Edges with a null end and loops are ignored, repeats and direction do not
    matter, other columns are not read; an empty table gives an empty result.

    A partition holds about ``partition_edges`` edges at most. The first level has at least the
    session's shuffle partitions. The random order is new on every level, so each level at least
    about halves the vertices that are left, whatever the shape of the graph (chains included).
    """
    spark = edges.sparkSession
    level, tasks = 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = stored(_links(edges.select(F.col(u).cast("bigint").alias("a"), F.col(v).cast("bigint").alias("b"))), "links")
    levels: list[DataFrame] = []
    while True:
        tasks = max(math.ceil(links._stored_rows / partition_edges), math.ceil(tasks / FAN_IN) if level else tasks)
        placed = links.repartitionByRange(tasks, "u", "v") if tasks > 1 else links.coalesce(1)
        forest = placed.select("u", "v", _turn("u", level), _turn("v", level)).mapInArrow(_forest, "vertex bigint, root bigint")
        forest = stored(forest, "forest")
        discard(links)
        if tasks == 1:
            labels = forest.withColumnRenamed("root", "top")
            break
        first = forest.groupBy("vertex").agg(F.min_by("root", _turn("root", level)).alias("parent"))
        above = first.select(F.col("vertex").alias("parent"), F.col("parent").alias("grand"))
        parents = stored(skew_join(first, above, ["parent"]).select("vertex", F.col("grand").alias("parent")), "parents")
        levels.append(parents)
        of_root = parents.select(F.col("vertex").alias("root"), F.col("parent").alias("b"))
        between = forest.join(parents, "vertex").select("root", F.col("parent").alias("a"))
        links = stored(_links(skew_join(between, of_root, ["root"])), "links")
        discard(forest)
        level += 1
    for parents in reversed(levels):
        # A parent without a link to another one is the top of its component.
        upper = labels.select(F.col("vertex").alias("parent"), "top")
        labels = skew_join(parents, upper, ["parent"], "left").select("vertex", F.coalesce("top", "parent").alias("top"))
    labels = stored(labels, "labels")
    least = labels.groupBy("top").agg(F.min("vertex").alias("group"))
    return skew_join(labels, least, ["top"]).select("vertex", "group")


def kinship_links(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """Edges (u, v) that link two different listed samples with a finite value other than zero."""
    listed = samples.select("sample_index").dropna().distinct()
    value = F.col("edge_values")
    good = edges.filter(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")) & (value != 0) & (F.col("edge_rows") != F.col("edge_cols")))
    pairs = good.select(F.col("edge_rows").alias("u"), F.col("edge_cols").alias("v"))
    for end in ("u", "v"):
        pairs = skew_join(pairs, listed.withColumnRenamed("sample_index", end), [end], "left_semi")
    return pairs
