"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs at most the tasks of one stage.  Only where that
setting is absent (plain local sessions) a folder of our own is used.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most about 100 bytes that may be broadcast; a side is counted first.
BROADCAST_ROWS = 200_000

_paths: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return (shared or os.path.join(tempfile.gettempdir(), "quillbook-scratch")).rstrip("/") + "/quillbook"


def stamp(spark: SparkSession, *paths: str) -> tuple:
    """Size and time of change of the files at ``paths``, in whatever store they are."""
    out = []
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
        for one in found or ():
            inside = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(one.getPath())
            out += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in inside)
    return tuple(out)


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        _delete(df._scratch_path)


def _delete(path: str) -> None:
    spark = _paths.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _leave_nothing() -> None:
    for path in list(_paths):
        try:
            _delete(path)
        except Exception:  # the JVM may be gone already at interpreter exit
            return


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small, else as it is.

    ``rows`` is the count where the caller knows it.  Beyond the bound the join
    shuffles, and adaptive execution splits skewed partitions.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df
