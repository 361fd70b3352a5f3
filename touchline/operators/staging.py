"""Written intermediate tables.

Iterative fits read one compact table many times. It is written once, as parquet, under the shared folder
named by ``spark.checkpoint.dir``: the lineage ends there, so a lost executor costs a re-read of a file and
never a re-run of the joins that made the table.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables; a temporary folder stands in for it in local mode only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="touchline-")
    return _local_roots[app]


def _new_path(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/staged/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jvm_path, True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` and return a scan of what was written. Kept until the session ends."""
    spark = df.sparkSession
    path = _new_path(spark)
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, column: str, parts: int) -> DataFrame:
    """``stage`` as a table bucketed by a column: grouping and windows by it need no shuffle when it is read."""
    spark = df.sparkSession
    path, name = _new_path(spark), f"staged_{uuid.uuid4().hex}"
    df.repartition(parts, column).write.bucketBy(parts, column).option("path", path).saveAsTable(name)
    _written.append((spark, path))
    _tables.append((spark, name))
    return spark.table(name)


def scratch_path(spark: SparkSession) -> str:
    """A new folder name under the staging root, removed when the session ends."""
    path = _new_path(spark)
    _written.append((spark, path))
    return path


FEW_PIECES = 4


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash the rows of a small input that comes in a handful of pieces over all cores.

    A file with one row group is one task however many joins follow. An input of more than ``FEW_PIECES`` splits
    is left as it is: at scale the scan has splits enough, and a shuffle only for width would cost more.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df.rdd.getNumPartitions()
    return df.repartition(cores, key) if pieces <= FEW_PIECES and pieces < cores else df


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """``stage`` for a block of work; the files go when the block ends."""
    spark = df.sparkSession
    path = _new_path(spark)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _delete(spark, path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Tables staged in the block hand ``most`` rows at a time to Python at most, for rows that hold whole texts or sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) > 0:
        most = min(most, int(before))
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def purge() -> None:
    """Remove the tables staged in this process. DataFrames that read them stop working."""
    while _tables:
        spark, name = _tables.pop()
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session is already gone, and its catalogue with it
            pass
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session is already gone: the folder owner cleans up
            pass


atexit.register(purge)
