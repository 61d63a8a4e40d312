"""Annotation, gene, promoter, trait and covariate files, and the result sinks."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import masks, rejects
from ..operators.identity import LEGACY_ID
from .plink import numbered

TAR_ROWS = 50_000


def read_annotations(spark: SparkSession, path: str, mapping: dict[str, str], member: str | None = None) -> DataFrame:
    """Mapped columns of an annotation file, as text: CSV, TSV (also gzipped), Parquet, or a CSV/TSV member of a tar.gz.

    ``mapping`` is field name -> file column; other columns are not read. Empty text is null.
    """
    chosen = [F.col(f"`{source}`").cast("string").alias(field) for field, source in mapping.items()]
    plain = path.lower().removesuffix(".gz")
    if plain.endswith((".tar", ".tgz")):
        return _read_tar(spark, path, member, mapping)
    if plain.endswith(".parquet"):
        return spark.read.parquet(path).select(*chosen)
    separator = "\t" if plain.endswith((".tsv", ".txt", ".tab")) else ","
    return spark.read.csv(path, sep=separator, header=True, inferSchema=False, quote='"', escape='"').select(*chosen)


def _stream(path: str) -> BinaryIO:
    """A file of the shared folder or another file system, named as Spark does, to be read once from its start."""
    if path.startswith(("/", "file:")):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_stream(place, compression=None)


class _Once(io.RawIOBase):
    """A member of a streamed archive, which can't seek."""

    def __init__(self, member: BinaryIO):
        self.member = member

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.member.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _read_tar(spark: SparkSession, path: str, member: str | None, mapping: dict[str, str]) -> DataFrame:
    """An archive is read by one task, as a stream and in chunks; neither it nor a member is ever held whole or unpacked to disk."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place in batch["path"]:
                with _stream(place) as source, tarfile.open(fileobj=source, mode="r|*") as archive:
                    for entry in archive:
                        if not entry.isfile() or (member is not None and entry.name != member):
                            continue
                        separator = "," if ".csv" in entry.name else "\t"
                        packed = "gzip" if entry.name.endswith(".gz") else None
                        chunks = pd.read_csv(io.BufferedReader(_Once(archive.extractfile(entry))), sep=separator, dtype=str, keep_default_na=False, usecols=list(mapping.values()), compression=packed, chunksize=TAR_ROWS)
                        for chunk in chunks:
                            yield chunk.rename(columns={source: field for field, source in mapping.items()})[list(mapping)].replace("", None)

    schema = ", ".join(f"`{field}` string" for field in mapping)
    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(read, schema)


def read_manifest(path: str, chrom: str) -> dict:
    """The settings of one chromosome from an annotation manifest (JSON): common ones, then its overrides.

    Needs column_mapping, annotation_catalog, annotation_names (all within the catalogue) and qc_path.
    """
    with open(path) as f:
        manifest = json.load(f)
    settings = {k: v for k, v in manifest.items() if k != "chromosomes"} | manifest.get("chromosomes", {}).get(str(chrom), {})
    lacking = [k for k in ("column_mapping", "annotation_catalog", "annotation_names", "qc_path") if k not in settings]
    unknown = [n for n in settings.get("annotation_names", []) if n not in settings.get("annotation_catalog", {})]
    if lacking or unknown:
        raise ValueError(f"manifest lacks {lacking}, names unknown annotations {unknown}")
    return settings


def _whole(column: str) -> F.Column:
    """A positive whole number written as such or with a fraction of zeros, else null."""
    text = F.trim(F.col(column).cast("string"))
    return F.when(text.rlike(r"\A[0-9]+(\.0*)?\z"), F.regexp_replace(text, r"\..*", "").try_cast("bigint"))


def read_genes(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """ordinal, gene_name, chrom, start_pos, end_pos, problem of one chromosome's genes in file order."""
    rows = _in_order(spark.read.csv(path, header=True, inferSchema=False))
    named = rows.select("ordinal", F.col("hgnc_symbol").alias("gene_name"), masks.chromosome("chromosome_name").alias("chrom"), _whole("start_position").alias("start_pos"), _whole("end_position").alias("end_pos"))
    problem = F.when(F.coalesce("gene_name", F.lit("")) == "", "name").when(F.col("start_pos").isNull() | F.col("end_pos").isNull() | (F.col("start_pos") < 1) | (F.col("start_pos") > F.col("end_pos")), "position")
    return named.filter(F.col("chrom") == chrom).withColumn("problem", problem)


def read_ncrnas(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    rows = _in_order(spark.read.csv(path, header=True, inferSchema=False))
    return rows.select("ordinal", F.col("ncRNA").alias("gene_name"), masks.chromosome("chr").alias("chrom")).filter(F.col("chrom") == chrom)


def _in_order(df: DataFrame) -> DataFrame:
    return numbered(df, "ordinal")


def read_promoters(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start_pos, end_pos from a JSON list of intervals, or a TSV with optional header and # comments."""
    if path.endswith(".json"):
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("x"))
        rows = rows.select(F.col("x")[0].alias("chrom"), F.col("x")[1].alias("start"), F.col("x")[2].alias("end"))
    else:
        rows = spark.read.csv(path, sep="\t", comment="#", header=False, inferSchema=False)
        rows = rows.select(F.col("_c0").alias("chrom"), F.col("_c1").alias("start"), F.col("_c2").alias("end")).filter("lower(start) <> 'start'")
    return rows.select(masks.chromosome("chrom").alias("chrom"), F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered(spark.read.text(path), "n")
    return lines.select(F.lit(path).alias("file_name"), F.lit("csv").alias("kind"), (F.col("n") + 1).cast("int").alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))


def _header(lines: DataFrame) -> list[str]:
    first = lines.filter("line_no = 1").select(rejects._fields(F.regexp_replace("line", "\\A\ufeff", "")).alias("f")).first()
    names = [n.strip() for n in first["f"]] if first else []
    if not names or "" in names or len(set(names)) != len(names):
        raise ValueError("column names must be present, non-empty and unique")
    return names


def read_traits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(fid, iid, one double per named column; line_no, reason, line of failing records) of a phenotype or covariate CSV.

    FID and IID may stand anywhere in the header; missing tokens are null, infinities fail.
    """
    lines = _lines(spark, path)
    names = _header(lines)
    if not {"FID", "IID"} <= set(names):
        raise ValueError("FID and IID columns are required")
    order = [names.index("FID"), names.index("IID"), *(i for i, n in enumerate(names) if n not in ("FID", "IID"))]
    if order != list(range(len(names))):
        # Identifiers first: the record classifier takes them from there.
        fields = rejects._fields(F.col("line"))
        quote = lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))
        moved = F.concat_ws(",", *(quote(F.get(fields, F.lit(i))) for i in order))
        clean = ~rejects._quotes_removed(F.col("line")).contains('"') & (F.size(fields) == len(names))
        lines = lines.withColumn("line", F.when(clean, moved).otherwise(F.col("line")))
    loaded, rejected = rejects.split_lines(lines)
    values = [F.get("values", F.lit(k)).alias(names[i]) for k, i in enumerate(order[2:])]
    return loaded.select("fid", "iid", *values), rejected.select("line_no", "reason", "line")


def read_legacy(spark: SparkSession, path: str, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(eid bigint and the named doubles; eid, problem) of a CSV keyed by positive whole ids, each to occur once.

    Rows with a bad or repeated id (identifier, repeated) or a value that is neither missing nor a
    number (value) are set apart.
    """
    rows = spark.read.csv(path, header=True, inferSchema=False, nullValue="").select("eid", *names)
    texts = [rejects.trimmed(F.coalesce(F.col(f"`{n}`"), F.lit(""))) for n in names]
    bad_value = reduce(lambda a, b: a | b, (rejects.number(t).isNull() & ~rejects.is_missing(t) for t in texts), F.lit(False))
    many = rows.groupBy(F.col("eid").alias("_eid")).agg(F.count(F.lit(1)).alias("_many"))
    judged = rows.join(many, F.col("eid").eqNullSafe(F.col("_eid")))
    problem = F.when(~F.coalesce(F.col("eid").rlike(LEGACY_ID), F.lit(False)), "identifier").when(F.col("_many") > 1, "repeated").when(bad_value, "value")
    judged = judged.withColumn("problem", problem)
    values = [rejects.number(t).alias(n) for n, t in zip(names, texts, strict=True)]
    return judged.filter("problem is null").select(F.col("eid").cast("bigint").alias("eid"), *values), judged.filter("problem is not null").select("eid", "problem").distinct()


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """phenotype, family, profile, covariates (array) from a profile CSV with ;-separated covariate columns."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    return rows.select("phenotype", F.col("model_family").alias("family"), "profile", F.filter(F.split("covariate_columns", ";"), lambda c: c != "").alias("covariates"))


@F.pandas_udf(T.StringType())
def _number_text(values: pd.Series) -> pd.Series:
    """Seventeen significant digits without trailing zeros, which read back as the same number."""
    return values.map(lambda v: f"{v:.17g}", na_action="ignore").astype(object)


def as_text(df: DataFrame) -> DataFrame:
    """Cells as result files hold them: NaN, Inf and -Inf for special numbers, TRUE and FALSE, empty for null."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            finite = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("double"))
            c = F.when(F.isnan(c), "NaN").when(c == float("inf"), "Inf").when(c == float("-inf"), "-Inf").otherwise(_number_text(finite))
        elif kind == "boolean":
            c = F.upper(c.cast("string"))
        out.append(c.cast("string").alias(name))
    return df.select(*out)


def write_results(df: DataFrame, path: str, order: Sequence[str | Column], rows_per_file: int = 1_000_000, single_file: bool = False) -> None:
    """Sorted CSV with header; an empty result keeps its header. Columns that start with _ only order the rows. ``single_file`` is for results of a bounded size."""
    ordered = df.orderBy(*order).drop(*(c for c in df.columns if c.startswith("_")))
    text = as_text(ordered)
    if single_file or text.isEmpty():
        text = text.coalesce(1)
    text.write.mode("error").option("header", True).option("nullValue", "").option("emptyValue", "").option("maxRecordsPerFile", rows_per_file).csv(path)


def write_shards(df: DataFrame, path: str, keys: Sequence[str], rows_per_file: int = 1_000_000) -> None:
    """Gzipped CSV shards in a folder per value of ``keys``."""
    as_text(df).write.mode("error").partitionBy(*keys).option("header", True).option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).csv(path)


def gene_rows_as_text(table: DataFrame) -> DataFrame:
    """A gene table whose neighbour, UTR and ncRNA rows hold Chr and #SNV as text (all rows then do)."""
    return table.withColumn("Chr", F.col("Chr").cast("string")).withColumn("#SNV", F.col("`#SNV`").cast("string"))
