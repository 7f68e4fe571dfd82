"""A mergeable log-linear histogram: 128 buckets for each power of two.

Values below 256 have buckets of their own; above, a bucket's width is at most
1/128 of its lowest value.  A histogram is a table ``bucket, n`` (by any keys) and
merges by summing; quantiles are nearest-rank and answer a bucket's highest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets per power of two.
SUB = 128


def bucket_of(value: Column) -> Column:
    """The bucket of a non-negative integer."""
    shift = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return (shift * SUB + F.call_function("shiftright", value, shift)).cast("long")


def _shift(bucket: Column) -> Column:
    return F.greatest(F.floor(bucket / SUB) - 1, F.lit(0)).cast("int")


def lowest_of(bucket: Column) -> Column:
    shift = _shift(bucket)
    return F.call_function("shiftleft", (bucket - shift * SUB).cast("long"), shift)


def highest_of(bucket: Column) -> Column:
    return lowest_of(bucket) + F.call_function("shiftleft", F.lit(1).cast("long"), _shift(bucket)) - 1


def histogram(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """``keys, bucket, n`` with the exact ``total`` (a decimal: nanoseconds of many rows
    exceed 64 bits), ``least`` and ``most`` of the bucket's values."""
    rows = df.withColumn("_v", value)
    return rows.groupBy(*keys, bucket_of(F.col("_v")).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum(F.col("_v").cast("decimal(20,0)")).alias("total"), F.min("_v").cast("long").alias("least"), F.max("_v").cast("long").alias("most")
    )


def merge(hist: DataFrame, *keys: str) -> DataFrame:
    """Histograms added up to the coarser ``keys``."""
    return hist.groupBy(*keys, "bucket").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")
    )


def quantiles(hist: DataFrame, shares: dict[str, float], *keys: str) -> DataFrame:
    """``keys, n, mean, <name>..., max``: the nearest-rank quantiles, by key.  At or
    below 0 the exact least, at or above 1 the exact most."""
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = hist.select(
        *keys, "bucket", "n", "total", "least", "most",
        F.sum("n").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(whole).alias("all"),
        F.max("most").over(whole).alias("top"),
    )

    def at(q: float) -> Column:
        if q <= 0:
            return F.min("least")
        if q >= 1:
            return F.max("most")
        rank = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("all")))
        return F.least(F.min(F.when(F.col("upto") >= rank, highest_of(F.col("bucket")))), F.max("top"))

    out = ranked.groupBy(*keys).agg(
        F.sum("n").cast("long").alias("n"), F.sum("total").alias("_sum"), *[at(q).cast("long").alias(name) for name, q in shares.items()],
        F.max("most").alias("max"),
    )
    return out.withColumn("mean", F.col("_sum").cast("double") / F.col("n")).drop("_sum")
