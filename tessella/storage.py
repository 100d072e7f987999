"""Cutting lineage through the shared folder, and small helpers around it.

Intermediate tables are written as Parquet below the folder named by ``spark.checkpoint.dir``. Every
executor can read that folder, so a lost executor costs a re-read and nothing else. Only where the
setting is missing (tests, notebooks) a local folder is made.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none."""
    global _local_folder
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get().rstrip("/")
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="tessella-")
    return "file://" + _local_folder


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """The driver's file system removes the path when its JVM ends, also after the session was stopped."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut.

    Columnar and compressed, so later stages read only the columns they use. The table is removed
    when the driver program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{os.getpid()}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict[tuple, str] = {}


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of change of the files of a table: what tells whether something derived from it still holds."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(target)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in (fs.listStatus(target) if status.isDirectory() else [status])))


def kept(spark: SparkSession, label: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that is built once per session and read again as long as its input files are the same."""
    key = (spark.sparkContext.applicationId, label, tuple(fingerprint(spark, p) for p in inputs))
    if key not in _kept:
        df = build()
        path = f"{shared_folder(spark)}/{label}-{os.getpid()}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        delete_at_exit(spark, path)
        _kept[key] = path
    return spark.read.parquet(_kept[key])


def scalar(df: DataFrame):
    """The single value of a one-row, one-column result."""
    row = df.head()
    return None if row is None else row[0]
