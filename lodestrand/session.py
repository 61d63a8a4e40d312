"""Session settings, table access and lineage cuts in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: Rows up to which a side is broadcast; at under 400 bytes a row this stays below 40 MB.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's setting, else (local tests) one made for this session."""
    where = spark.conf.get(_CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(_CHECKPOINT_SETTING)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_CHECKPOINT_SETTING} must name a folder that all executors share")
    where = spark.sparkContext.getCheckpointDir()
    if not where:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small state table; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_written: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there.

    The rows are counted while they are written, for ``small``. The folders are removed when the
    driver program ends, by ``release``, or one by one by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestrand/{name}-{uuid.uuid4().hex}"
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_path, back._stored_rows = path, counted.get["n"]
    return back


def discard(df: DataFrame) -> None:
    """Remove the table behind ``df``, as ``stored`` returned it, once nothing reads it any more."""
    at = next((i for i, (_, path) in enumerate(_written) if path == df._stored_path), None)
    if at is not None:
        _delete(*_written.pop(at))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Remove every table that ``stored`` wrote."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            pass


atexit.register(release)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows: known for tables of ``stored``, else counted by Spark up to that limit."""
    known = getattr(df, "_stored_rows", None)
    return (df.select(F.lit(1)).limit(rows + 1).count() if known is None else known) <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where the counted size allows it; otherwise ``df`` for a shuffle join."""
    return F.broadcast(df) if small(df, rows) else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers once per application, for sessions that do not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestrand_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "lodestrand.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._lodestrand_shipped = True
