"""What messages say about instruments: names, round lots, states, system events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import scratch
from .lifecycle import is_book


def directory(messages: DataFrame) -> DataFrame:
    """``locate, symbol, round_lot, state``: the last directory message and trading
    action of each locate (null where there was none)."""
    rows = messages.where(F.col("type").isin("R", "H"))
    named, acted = F.when(F.col("type") == "R", F.col("idx")), F.when(F.col("type") == "H", F.col("idx"))
    return rows.groupBy("locate").agg(
        F.max_by("stock", named).alias("symbol"), F.max_by("round_lot", named).alias("round_lot"), F.max_by("state", acted).alias("state"),
        (F.count(named) > 0).alias("known"),
    )


def last_system_event(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("type") == "S").agg(F.max_by("event_code", "idx").alias("event_code"))


def with_symbols(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with ``symbol`` by locate, empty where unknown.  There are 65,536
    locates at most, so names are broadcast."""
    return rows.join(scratch.small_side(names.select("locate", "symbol"), 65_536), "locate", "left").withColumn("symbol", F.coalesce("symbol", F.lit("")))


def event_kinds(messages: DataFrame) -> DataFrame:
    """``idx, kind`` of the pipeline's events: add, execute, cancel, delete, replace, none."""
    kind = F.when(F.col("type").isin("A", "F"), "add").when(F.col("type").isin("E", "C"), "execute").when(F.col("type") == "X", "cancel")
    return messages.select("idx", kind.when(F.col("type") == "D", "delete").when(F.col("type") == "U", "replace").otherwise("none").alias("kind"))


def blocks(messages: DataFrame, size: int = 1024) -> DataFrame:
    """``block, first, last, n, span_ns`` of every ``size`` messages of the stream."""
    rows = messages.groupBy(F.floor(F.col("idx") / size).alias("block"))
    return rows.agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"), (F.max("ts_ns") - F.min("ts_ns")).alias("span_ns"))


def book_share(messages: DataFrame) -> DataFrame:
    """``n, book``: all messages, and those that concern a book."""
    return messages.agg(F.count("*").alias("n"), F.count_if(is_book()).alias("book"))
