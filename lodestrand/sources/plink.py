"""PLINK files: BED as a partitioned data source, BIM and FAM as text."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.rejects import bad_identifier
from ..session import broadcast_if_small, stored

# Fixed values of the format: file header, and states by 2-bit code when the reference is the second or the first allele.
HEADER = bytes((0x6C, 0x1B, 0x01))
STATES = ((2, 3, 1, 0), (0, 3, 1, 2))
#: Bytes of a BED file that one task reads, about.
PART_BYTES = 32 << 20


class VariantRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class BedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.n_samples, self.n_variants = options["path"], int(options["samples"]), int(options["variants"])
        self.reference_is_a1 = options.get("reference_is_a1", "false").lower() == "true"
        self.stride = -(-self.n_samples // 4)

    def partitions(self) -> list[InputPartition]:
        with open(self.path, "rb") as f:
            header = f.read(3)
        if header != HEADER:
            raise ValueError("not a variant-major BED file")
        if os.path.getsize(self.path) != 3 + self.stride * self.n_variants:
            raise ValueError("the BED file's size does not fit its samples and variants")
        step = max(1, PART_BYTES // max(1, self.stride))
        return [VariantRange(v, min(v + step, self.n_variants)) for v in range(0, self.n_variants, step)] or [VariantRange(0, 0)]

    def read(self, partition: VariantRange) -> Iterator[pa.RecordBatch]:
        states = np.array(STATES[self.reference_is_a1], np.int32)
        used = 2 * (self.n_samples % 4)
        with open(self.path, "rb") as f:
            f.seek(3 + partition.first * self.stride)
            for variant in range(partition.first, partition.last):
                raw = np.frombuffer(f.read(self.stride), np.uint8)
                if len(raw) < self.stride:
                    raise ValueError("the BED file ends early")
                if used and raw[-1] >> used:
                    raise ValueError(f"variant {variant} has bits set behind its last sample")
                codes = (raw[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
                state = states[codes.ravel()[: self.n_samples]]
                samples = np.flatnonzero(state)
                if len(samples):
                    columns = [pa.array(np.full(len(samples), variant, np.int64)), pa.array(samples.astype(np.int64)), pa.array(state[samples])]
                    yield pa.RecordBatch.from_arrays(columns, names=["variant_idx", "sample_idx", "state"])


class BedSource(DataSource):
    """``spark.read.format("bed")`` with options path, samples, variants and reference_is_a1.

    Gives variant_idx, sample_idx and state of every call that is not homozygous reference. The file
    lies on storage that executors mount; each task reads its own range of variants.
    """

    @classmethod
    def name(cls) -> str:
        return "bed"

    def schema(self) -> str:
        return "variant_idx bigint, sample_idx bigint, state int"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return BedReader(self.options)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 0 in reading order, from positions inside partitions and the sizes of those before."""
    placed = stored(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", F.shiftright("_at", 33)).join(broadcast_if_small(before), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before", "_at")


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """sample_idx, fid, iid, pat, mat, sex, pheno, problem; problem is null, column_count or identifier."""
    lines = numbered(spark.read.text(path), "sample_idx")
    fields = F.split(F.regexp_replace("value", r"\A[ \t]++|[ \t]++\z", ""), "[ \t]++", -1)
    named = [F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(("fid", "iid", "pat", "mat", "sex", "pheno"))]
    problem = F.when(F.size(fields) != 6, "column_count").when(bad_identifier(F.get(fields, F.lit(0))) | bad_identifier(F.get(fields, F.lit(1))), "identifier")
    return lines.select("sample_idx", *named, problem.alias("problem"))


def read_bim(spark: SparkSession, path: str, chrom: str | None = None, reference_is_a1: bool = False) -> DataFrame:
    """variant_idx, chrom, id, pos, ref, alt, problem of every line; problem is null or the first rule broken.

    Rules: column_count (six fields), chromosome (the one asked for), position (whole and at least
    1), alleles (two different known ones), order (no position below the line before), identity (an
    id of the form CHR:POS:REF:ALT that contradicts the line).
    """
    lines = numbered(spark.read.text(path), "variant_idx")
    fields = F.split(F.trim("value"), r"\s+", -1)
    get = lambda i: F.get(fields, F.lit(i))
    ref, alt = (get(4), get(5)) if reference_is_a1 else (get(5), get(4))
    pos = F.when(get(3).rlike(r"\A[0-9]{1,18}\z"), get(3).try_cast("bigint"))
    rows = lines.select("variant_idx", F.size(fields).alias("_n"), F.upper(F.regexp_replace(get(0), "(?i)^chr", "")).alias("chrom"), get(1).alias("id"), pos.alias("pos"), ref.alias("ref"), alt.alias("alt"))
    before = rows.select((F.col("variant_idx") + 1).alias("variant_idx"), F.col("pos").alias("_before"))
    rows = rows.join(before, "variant_idx", "left")
    known = lambda c: F.col(c).rlike(r"\A[ACGTacgt]+\z")
    parts = F.split("id", ":")
    spelled = F.size(parts) == 4
    says = F.concat_ws(":", F.upper(F.regexp_replace(parts[0], "(?i)^chr", "")), parts[1], parts[2], parts[3])
    problem = (
        F.when(F.col("_n") != 6, "column_count")
        .when(F.col("chrom") != chrom if chrom is not None else F.lit(False), "chromosome")
        .when(F.coalesce(F.col("pos"), F.lit(0)) < 1, "position")
        .when(~known("ref") | ~known("alt") | (F.col("ref") == F.col("alt")), "alleles")
        .when(F.col("pos") < F.col("_before"), "order")
        .when(spelled & (says != F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt")), "identity")
    )
    return rows.withColumn("problem", problem).drop("_n", "_before")


def read_bed(spark: SparkSession, path: str, n_samples: int, n_variants: int, reference_is_a1: bool = False) -> DataFrame:
    spark.dataSource.register(BedSource)
    return spark.read.format("bed").option("samples", n_samples).option("variants", n_variants).option("reference_is_a1", str(reference_is_a1)).load(path)


def select_calls(calls: DataFrame, samples: DataFrame | None = None, variants: DataFrame | None = None) -> DataFrame:
    """Calls of chosen samples (sample_idx, new_idx) and variants (variant_idx, new_idx), renumbered."""
    for key, chosen in (("sample_idx", samples), ("variant_idx", variants)):
        if chosen is not None:
            calls = calls.join(broadcast_if_small(chosen.select(key, F.col("new_idx").alias("_new"))), key).drop(key).withColumnRenamed("_new", key)
    return calls.select("variant_idx", "sample_idx", "state")
