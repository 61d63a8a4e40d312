"""Packing of documents into fixed-capacity containers by bulk-synchronous best-fit.

Pieces (documents, and the parts of those above the capacity) and gaps (what is free in open
containers) are distributed tables. Pieces come in bands of size, large to small. A superstep
range-sorts the pieces of every kind's band together with the gaps that can hold one, and with new
containers, by descending size. Each partition sweeps its stretch: every piece finds its successor,
the tightest gap met so far that no piece before it took. What a sweep leaves over (pieces of one
partition, gaps of an earlier one) is matched by rank: with the counts of the partitions before,
pieces and gaps get a level, and a piece takes the last gap before it on its level. Gaps are then
updated and the next superstep follows: what is left of the band, or the next band.

A gap that holds several pieces of the band's largest size offers as many places in one superstep.
New containers are opened no faster than the tokens that are left need, so that gaps are always
tried first; this gives about what best-fit decreasing gives piece by piece. The number of
supersteps depends on the capacity's bands, not on the number of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, shared_dir, stored

_PIECE = ["kind", "size", "doc_id", "piece_no"]


def successors(kind: np.ndarray, is_piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, gaps): positions of matches in one sorted stretch; each piece takes the last free gap of its kind before it."""
    depth = np.cumsum(np.where(is_piece, -1, 1)) + is_piece
    order = np.lexsort((np.arange(len(depth)), depth, kind))
    first, then = order[:-1], order[1:]
    hit = ~is_piece[first] & is_piece[then] & (depth[first] == depth[then]) & (kind[first] == kind[then])
    return then[hit], first[hit]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matched pieces with their container; free pieces and gaps with their rank among those of their kind."""
    parts = list(batches)
    if not parts:
        return
    rows = pa.Table.from_batches(parts).combine_chunks()
    kind, is_piece = rows["kind"].to_numpy(), rows["is_piece"].to_numpy()
    container = rows["container_id"].to_numpy().copy()
    pieces, gaps = successors(kind, is_piece)
    container[pieces] = container[gaps]
    state = np.zeros(len(kind), np.int32)  # 0 free, 1 matched piece, 2 taken gap
    state[pieces], state[gaps] = 1, 2
    rank = np.zeros(len(kind), np.int64)
    for which in (is_piece & (state == 0), ~is_piece & (state == 0)):
        at = np.flatnonzero(which)
        begin = np.searchsorted(kind[at], kind[at], side="left")
        rank[at] = np.arange(len(at)) - begin
    out = rows.set_column(rows.schema.get_field_index("container_id"), "container_id", pa.array(container))
    out = out.append_column("matched", pa.array(state == 1)).append_column("rank", pa.array(rank))
    yield from out.filter(pa.array(state < 2)).to_batches()


def match(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """kind, size, doc_id, piece_no, container_id (null where no gap was left) of every piece of ``events``; and the stored table it reads.

    ``events`` has kind, width, is_piece and the columns of the result; of a piece container_id is
    -1, of a gap the other columns are null. A piece fits gaps of its width or more.
    """
    # Gaps come before pieces of their width, and containers opened first are met last, so they fill first.
    order = [F.expr(e) for e in ("kind", "-width", "is_piece", "-container_id", "doc_id", "piece_no")]
    placed = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema) + ", matched boolean, rank bigint"
    swept = stored(placed.mapInArrow(_sweep, schema), "swept")
    free = swept.filter("not matched")
    # The counts have a row per partition and kind, so their window is small; a level has at most two rows per partition.
    counts = free.groupBy("kind", "part").agg(F.expr("count_if(is_piece) pieces"), F.expr("count_if(not is_piece) gaps"))
    counts = counts.selectExpr("kind", "part", "pieces", "coalesce(sum(gaps - pieces) over (partition by kind order by part rows between unbounded preceding and 1 preceding), 0) depth")
    across = free.join(F.broadcast(counts), ["kind", "part"]).selectExpr(*free.columns, "if(is_piece, depth - rank, depth - pieces + rank + 1) level")
    gap_before = "lag(if(is_piece, null, container_id)) over (partition by kind, level order by part, is_piece desc)"
    across = across.selectExpr(*_PIECE, "is_piece", f"{gap_before} container_id").filter("is_piece").drop("is_piece")
    return swept.filter("matched").select(*_PIECE, "container_id").unionByName(across), swept


def _band(size: Column, capacity: Column) -> Column:
    """Two bands per halving of the size, so that one and a half or two pieces of a band's largest size make one of the band's before."""
    share = capacity / size
    halvings = F.floor(F.log2(share))
    return (2 * halvings + (share / F.pow(F.lit(2.0), halvings) >= 1.5).cast("int")).cast("int")


class _Band:
    """What is known of the pieces that are left of a kind's band, and how many containers to open for them."""

    def __init__(self, pieces: int, tokens: int, least: int, most: int):
        self.pieces, self.tokens, self.least, self.most = pieces, tokens, least, most

    def openings(self, capacity: int, widest_gap: int, tried: bool) -> int:
        if widest_gap < self.least:  # no gap holds any of the pieces
            return self.pieces if 2 * self.least > capacity else -(-self.tokens // capacity)
        if not tried:
            return 0
        return self.pieces if 2 * self.least > capacity else max(1, self.tokens // capacity)


def _per_kind(of: list[int]) -> str:
    """The value of each kind, by its number, in SQL."""
    return f"element_at(array({', '.join(f'{v}L' for v in of)}), kind + 1)"


def _left_over(kinds: int) -> list[Column]:
    """Aggregates of the unplaced pieces of every kind, to be observed while they are written."""
    out = []
    for k in range(kinds):
        own = f"if(kind = {k} and container_id is null, size, null)"
        out += [f"count({own}) pieces{k}", f"coalesce(sum({own}), 0) tokens{k}", f"coalesce(min({own}), 0) least{k}", f"coalesce(max({own}), 0) most{k}"]
    return [F.expr(e) for e in out]


def _new_containers(spark: SparkSession, first: list[int], many: list[int]) -> DataFrame:
    """(kind, container_id) of the containers that each kind opens, as a distributed range."""
    ends = [sum(many[: k + 1]) for k in range(len(many))]
    kind = "case " + " ".join(f"when id < {end}L then {k}" for k, end in enumerate(ends)) + " end"
    number = "case " + " ".join(f"when id < {end}L then id + {first[k] - end + many[k]}L" for k, end in enumerate(ends)) + " end"
    return spark.range(ends[-1]).selectExpr(f"{kind} kind", f"{number} container_id")


def pack(sizes: DataFrame, specs: DataFrame, doc_id: str = "doc_id", n_tokens: str = "n_tokens") -> DataFrame:
    """container_name, container_id, doc_id, piece_no, token_from, n_tokens, position of every piece in every kind of container.

    ``sizes`` (stored; doc_id unique, n_tokens) is packed once for each row of ``specs``
    (container_name, capacity_tokens; a short table, whose last row wins for a repeated name). A
    document above the capacity is cut into full pieces and a rest, all others stay whole;
    token_from is where the piece starts in its document, position where it starts in its container.
    container_id is unique within its kind. Documents of null, zero or negative size need no place
    and give no row, and neither do specs of null or no capacity. Ties in size are ordered by doc_id
    and piece_no; an empty table gives an empty result; other columns are not read.
    """
    spark = sizes.sparkSession
    kinds = sorted({r[0]: r[1] for r in specs.select("container_name", F.col("capacity_tokens").cast("bigint")).collect() if r[0] is not None and (r[1] or 0) > 0}.items())
    docs = sizes.select(F.col(doc_id).alias("doc_id"), F.col(n_tokens).cast("bigint").alias("tokens")).filter("tokens > 0")
    if not kinds:
        return docs.filter("false").selectExpr("'' container_name", "0L container_id", "doc_id", "0L piece_no", "0L token_from", "0L n_tokens", "0L position")
    capacities = [c for _, c in kinds]
    every = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in enumerate(capacities))))
    whole = docs.withColumn("spec", every).select("doc_id", "tokens", "spec.*")
    last = F.ceil(F.col("tokens") / F.col("capacity")).cast("bigint") - 1
    cut = whole.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    cut = cut.withColumn("size", F.least("capacity", F.col("tokens") - F.col("piece_no") * F.col("capacity"))).withColumn("band", _band(F.col("size"), F.col("capacity")))
    pieces = stored(cut.select(*_PIECE, "band").repartitionByRange("kind", "band").sortWithinPartitions("kind", "band"), "pieces")

    bands: list[list[tuple[int, _Band]]] = [[] for _ in kinds]
    found = pieces.groupBy("kind", "band").agg(F.count(F.lit(1)), F.sum("size"), F.min("size"), F.max("size")).collect()  # two rows per halving of a capacity
    for kind, band, *known in sorted(map(tuple, found), reverse=True):
        bands[kind].append((band, _Band(*known)))  # the first band is last
    smallest = [min((b.least for _, b in own), default=0) for own in bands]

    where = f"{shared_dir(spark)}/lodestrand/packed-{uuid.uuid4().hex}"
    gaps = stored(spark.range(0).select(F.lit(0).alias("kind"), F.col("id").alias("container_id"), F.col("id").alias("gap")), "gaps")
    widest, opened = [0] * len(kinds), [0] * len(kinds)
    now: list[_Band | None] = [None] * len(kinds)
    tried = [False] * len(kinds)
    left: DataFrame | None = None
    step = 0
    while any(bands) or any(now):
        fresh = []
        for k, own in enumerate(bands):
            if now[k] is None and own:
                band, now[k] = own.pop()
                tried[k] = False
                fresh.append((k, band))
        sources = [] if left is None else [left]
        if fresh:
            sources.append(pieces.filter(" or ".join(f"(kind = {k} and band = {b})" for k, b in fresh)).select(*_PIECE))
        waiting = reduce(DataFrame.unionByName, sources)
        many = [b.openings(c, w, t) if b else 0 for b, c, w, t in zip(now, capacities, widest, tried, strict=True)]
        most, least = [b.most if b else 1 for b in now], [b.least if b else c + 1 for b, c in zip(now, capacities, strict=True)]
        capacity = _per_kind(capacities)
        new = _new_containers(spark, opened, many).selectExpr("kind", "container_id", f"{capacity} gap")
        usable = gaps.filter(f"gap >= {_per_kind(least)}").unionByName(new)
        slots = usable.selectExpr("kind", "container_id", "gap", f"greatest(1L, gap div {_per_kind(most)}) places").selectExpr("kind", "gap div places width", "container_id", "explode(sequence(1L, places)) place")
        events = slots.selectExpr("kind", "width", "false is_piece", "null size", "null doc_id", "null piece_no", "container_id").union(
            waiting.selectExpr("kind", "size width", "true is_piece", "size", "doc_id", "piece_no", "-1L container_id")
        )
        matched, swept = match(events)
        seen = Observation()
        here = f"{where}/step={step}"
        matched.observe(seen, *_left_over(len(kinds))).write.option("compression", "zstd").parquet(here)
        discard(swept)
        result = spark.read.schema(matched.schema).parquet(here)

        changes = gaps.selectExpr("kind", "container_id", "gap change", "true known").union(result.filter("container_id is not null").selectExpr("kind", "container_id", "-size", "false"))
        after = changes.groupBy("kind", "container_id").agg(F.expr("sum(change) change"), F.expr("bool_or(known) known"))
        after = after.selectExpr("kind", "container_id", f"change + if(known, 0L, {capacity}) gap").filter(f"gap >= {_per_kind(smallest)}")
        width = Observation()
        before, gaps = gaps, stored(after.observe(width, *(F.expr(f"coalesce(max(if(kind = {k}, gap, null)), 0) w{k}") for k in range(len(kinds)))), "gaps")
        discard(before)
        rest, wide = seen.get, width.get
        for k in range(len(kinds)):
            opened[k] += many[k]
            widest[k], tried[k] = wide[f"w{k}"], True
            now[k] = _Band(*(rest[f"{c}{k}"] for c in ("pieces", "tokens", "least", "most"))) if rest[f"pieces{k}"] else None
        left = result.filter("container_id is null").select(*_PIECE) if any(now) else None
        step += 1
    discard(gaps)
    if not step:
        return pack(sizes.filter("false"), specs.filter("false"), doc_id, n_tokens)
    return _positions(spark, where, pieces, kinds)


def _positions(spark: SparkSession, where: str, pieces: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """The placed pieces of all supersteps, with where each starts in its container: those of earlier supersteps come first."""
    placed = spark.read.schema("kind int, size bigint, " + f"doc_id {pieces.schema['doc_id'].dataType.simpleString()}" + ", piece_no bigint, container_id bigint, step int").parquet(where).filter("container_id is not null")
    inside = Window.partitionBy("kind", "container_id").orderBy("step", "doc_id", "piece_no").rowsBetween(Window.unboundedPreceding, -1)  # at most a capacity's tokens
    name = F.element_at(F.array(*(F.lit(n) for n, _ in kinds)), F.col("kind") + 1)
    capacity = F.element_at(F.array(*(F.lit(c).cast("bigint") for _, c in kinds)), F.col("kind") + 1)
    return placed.select(
        name.alias("container_name"), "container_id", "doc_id", "piece_no", (F.col("piece_no") * capacity).alias("token_from"), F.col("size").alias("n_tokens"), F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("bigint").alias("position")
    )


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per kind of container: containers, tokens held, and the share of the capacity in use."""
    kinds = specs.select("container_name", "capacity_tokens").distinct()
    per_kind = packed.groupBy("container_name").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return per_kind.join(kinds, "container_name").withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))


def audit(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per kind of container: documents held whole, and how many documents, containers and positions break the rules.

    A document is whole when its pieces follow each other from its first token; a document is split
    although it fits when it has several pieces and no more tokens than the capacity; a container is
    overfull beyond its capacity; its pieces must start where those before them end.
    """
    kinds = specs.select("container_name", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    limit = F.first("capacity")
    rows = packed.join(F.broadcast(kinds), "container_name")  # a short table
    of_doc = rows.groupBy("container_name", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("token_from") + F.col("n_tokens")).alias("end"), F.min("token_from").alias("start"), F.count_distinct("token_from").alias("parts"), F.count(F.lit(1)).alias("pieces"), limit.alias("capacity"))
    whole = (F.col("start") == 0) & (F.col("end") == F.col("n")) & (F.col("parts") == F.col("pieces"))
    docs = of_doc.groupBy("container_name").agg(F.count_if(whole).alias("n_whole"), F.count_if(~whole).alias("n_broken"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity"))).alias("n_split"))
    of_container = rows.groupBy("container_name", "container_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("position") + F.col("n_tokens")).alias("end"), F.min("position").alias("start"), F.count_distinct("position").alias("places"), F.count(F.lit(1)).alias("pieces"), limit.alias("capacity"))
    dense = (F.col("start") == 0) & (F.col("end") == F.col("n")) & (F.col("places") == F.col("pieces"))
    containers = of_container.groupBy("container_name").agg(F.count_if(F.col("n") > F.col("capacity")).alias("n_overfull"), F.count_if(~dense).alias("n_gappy"))
    return docs.join(containers, "container_name")
