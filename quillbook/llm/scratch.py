"""Intermediate tables, as in the rest of the library, and small Arrow batches."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ..plans import scratch as _shared
from ..plans.scratch import folder, forget, small_side

__all__ = ["bounded_batches", "folder", "forget", "let_go", "rows_that_may_be_broadcast", "small_side", "table"]

#: Rows and bytes that a Python worker gets at once: whole texts are in them, and both
#: sides of the pipe hold a batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to ``BATCH`` where they are higher.
    They hold when a table is computed, which for a lazy result is after the operator
    returned; so they stay."""
    for key, bound in BATCH.items():
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= bound:
            spark.conf.set(key, str(bound))


def table(df: DataFrame, label: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return _shared.table(df, label)


def let_go(spark: SparkSession) -> None:
    """Have the driver drop the plans, generated classes and broadcasts of the steps before.
    A loop of many small plans otherwise fills the heap and, beside it, the space of
    classes, which is only emptied with the heap."""
    gc.collect()  # Python's references keep plans alive in the JVM
    spark.sparkContext._jvm.System.gc()


def rows_that_may_be_broadcast() -> int:
    return _shared.BROADCAST_ROWS
