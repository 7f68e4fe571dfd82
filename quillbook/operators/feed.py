"""Slices of a stream, measured windows and send schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import scratch
from .workload import top_symbols


def first_n(messages: DataFrame, n: int) -> DataFrame:
    """The first ``n`` messages of the stream (a range of ``idx``, not any n rows)."""
    return messages.where(F.col("idx") < n)


def by_symbols(messages: DataFrame, locates: list[int], k: int = 0) -> DataFrame:
    """System events, the messages of ``locates`` from their directory message on, and
    all messages of the ``k`` most active locates.  Streams without directory
    messages know their locates from the start."""
    known = messages.where(F.col("type") == "R").groupBy("locate").agg(F.min("idx").alias("from"))
    met = messages.join(F.broadcast(known), "locate", "left")
    chosen = F.col("locate").isin(locates) & (F.col("idx") >= F.coalesce("from", F.lit(0)))
    if k:
        top = top_symbols(messages, k).select("locate", F.lit(True).alias("top"))  # k rows
        met = met.join(F.broadcast(top), "locate", "left")
        chosen = chosen | F.coalesce("top", F.lit(False))
    return met.where((F.col("type") == "S") | chosen).select(*messages.columns)


def by_locate(messages: DataFrame, locate: int, last: int) -> DataFrame:
    """System events and one locate, up to message ``last``: enough to replay a mismatch."""
    return messages.where((F.col("idx") <= last) & ((F.col("type") == "S") | (F.col("locate") == locate)))


def window(messages: DataFrame, start_ns: int, size: int | None = None) -> DataFrame:
    """All messages up to the end of the window, with ``measured``: the ``size`` messages
    (None: all) from the first at or after ``start_ns`` on.  An incomplete window is an
    error."""
    first = messages.where(F.col("ts_ns") >= start_ns).agg(F.min("idx")).first()[0]
    last = messages.agg(F.max("idx")).first()[0]
    if first is None or size is not None and last < first + size - 1:
        raise ValueError(f"the stream ends before {size or 'any'} messages from {start_ns} ns on")
    rows = messages if size is None else messages.where(F.col("idx") < first + size)
    return rows.withColumn("measured", F.col("idx") >= first)


def smooth(measured: DataFrame, rate: float) -> DataFrame:
    """``idx, offset_ns``: messages sent evenly at ``rate`` a second."""
    rows = measured.where("measured")
    first = rows.agg(F.min("idx")).first()[0]
    return rows.select("idx", F.round((F.col("idx") - first) * F.lit(1e9 / rate)).cast("long").alias("offset_ns"))


def bursty(measured: DataFrame, rate: float) -> DataFrame:
    """``idx, offset_ns``: the feed's own times, scaled to the same mean rate and never
    falling.  A window without a span is an error."""
    rows = measured.where("measured").select("idx", "ts_ns")
    ends = rows.agg(F.min_by("ts_ns", "idx"), F.max_by("ts_ns", "idx"), F.count("*")).first()
    first, last, size = ends
    if last == first:
        raise ValueError("the window has no span of time")
    scale = (size - 1) * (1e9 / rate) / (last - first)
    raw = rows.withColumn("raw", F.when(F.col("ts_ns") >= first, F.round((F.col("ts_ns") - first) * F.lit(scale)).cast("long")).otherwise(0))
    # running maximum within stretches, and the maxima of the stretches before
    dealt = raw.withColumn("stretch", F.floor(F.col("idx") / (1 << 16)))
    tops = dealt.groupBy("stretch").agg(F.max("raw").alias("top"))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("stretch", F.coalesce(F.max("top").over(before), F.lit(0)).alias("floor"))
    upto = Window.partitionBy("stretch").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumn("own", F.max("raw").over(upto)).join(scratch.small_side(tops), "stretch")
    return met.select("idx", F.greatest("own", "floor").cast("long").alias("offset_ns"))
