"""Results as files: CSV, one-row JSON, and tables for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import histogram as H


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """CSV files with a header, in order over and within files."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True)


def write_histogram(hist: DataFrame, path: str) -> None:
    """``low, high, count`` of non-empty buckets; the last upper bound is the largest value."""
    top = hist.agg(F.max("most").alias("top"))
    rows = hist.crossJoin(F.broadcast(top)).select(  # one row
        H.lowest_of(F.col("bucket")).alias("low"), F.least(H.highest_of(F.col("bucket")), F.col("top")).alias("high"), F.col("n").alias("count")
    )
    write_csv(rows, path, "low")


def read_histograms(spark: SparkSession, pattern: str) -> DataFrame:
    """Written histograms ``<variant>/<run>...`` with ``variant`` and ``run`` from their paths."""
    rows = spark.read.csv(pattern, header=True, schema="low long, high long, count long").withColumn("file", F.input_file_name())
    parts = F.split("file", "/")
    return rows.select(
        F.regexp_extract("file", r"/([^/]+)/([^/.]+)[^/]*(?:/[^/]*)?$", 1).alias("variant"),
        F.regexp_extract("file", r"/([^/]+)/([^/.]+)[^/]*(?:/[^/]*)?$", 2).alias("run"),
        F.element_at(parts, -1).alias("name"), "low", "high", "count",
    )


def write_json(one_row: DataFrame, path: str) -> None:
    """A one-row result as a JSON object."""
    one_row.select(F.to_json(F.struct(*one_row.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_metadata(runs: DataFrame, path: str) -> None:
    """A JSON object per run (``variant, run`` and any other columns)."""
    runs.write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def with_metadata(hist: DataFrame, meta: DataFrame, *names: str) -> DataFrame:
    """``hist`` with its run's metadata by name; a histogram without metadata is left out, as
    its unit is unknown.  Columns of both are the histogram's, the others' ``meta_...``."""
    own = [c for c in meta.columns if c not in names]
    renamed = meta.select(*names, *[F.col(c).alias(f"meta_{c}" if c in hist.columns else c) for c in own])
    return hist.join(renamed, list(names))


def markdown(small: DataFrame, limit: int = 1000) -> str:
    """A small result as a table; more rows than ``limit`` are an error."""
    rows = small.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are not a table to read")
    head = f"| {' | '.join(small.columns)} |\n|{'---|' * len(small.columns)}"
    return "\n".join([head, *(f"| {' | '.join('' if v is None else f'{v:.3f}' if isinstance(v, float) else str(v) for v in r)} |" for r in rows)])
