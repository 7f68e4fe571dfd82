"""Rows that match a set of keys, without a shuffle of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: A filter of keys is words of ``BITS`` bits; ``KEYS`` keys are expected in a word, each of
#: which sets two bits, so that about one other key in 40 passes.
BITS, KEYS = 8192, 680
#: Words that may be broadcast: of 1 KB each.
WORDS = 65_536


def _slots(key: Column) -> list[Column]:
    """The two bits of a 64-bit key in its word."""
    one = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(BITS))
    two = F.pmod(F.xxhash64(key, F.lit(2)), F.lit(BITS))
    return [one.cast("int"), two.cast("int")]


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(3)), F.lit(words)).cast("int")


def key_filter(keys: DataFrame, key: str, words: int) -> DataFrame:
    """``word, bits``: a Bloom filter of ``keys``, a row for each word that has a key."""
    slots = keys.select(_word(F.col(key), words).alias("word"), F.explode(F.array(*_slots(F.col(key)))).alias("slot"))
    longs = slots.groupBy("word", (F.col("slot") / 64).cast("int").alias("long")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63))).alias("bits")
    )
    whole = longs.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("long", "bits"))).alias("m"))
    zero = F.lit(0).cast("long")
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), zero))
    return whole.select("word", bits.alias("bits"))


def holds(keys: int) -> bool:
    """Whether a filter of so many keys may be broadcast (44 million may)."""
    return keys <= WORDS * KEYS


def flagged(rows: DataFrame, key: str, keys: DataFrame, n: int, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: true wherever the 64-bit ``key`` is one of the
    ``n`` ``keys``, and for about one other row in 40."""
    words = max(1, -(-n // KEYS))
    made = scratch.table(key_filter(keys, key, words), "key_filter")
    names = rows.columns
    made = made.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))  # at most ``WORDS`` rows of 1 KB
    met = rows.withColumn("_word", _word(F.col(key), words)).join(F.broadcast(made), "_word", "left")
    hit = [F.call_function("shiftright", F.get("_bits", (s / 64).cast("int")), s.bitwiseAND(63)).bitwiseAND(1) == 1 for s in _slots(F.col(key))]
    return met.select(*names, F.coalesce(hit[0] & hit[1], F.lit(False)).alias(name))


def passing(rows: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """The rows that may have one of ``keys``: all that do, and about one other in 40;
    all rows where a filter of so many keys may not be broadcast."""
    return flagged(rows, key, keys, n, "_maybe").where("_maybe").drop("_maybe") if holds(n) else rows


def matched(rows: DataFrame, key: str, sides: DataFrame) -> DataFrame:
    """``rows`` joined with ``sides`` on the 64-bit ``key``.  A side that is counted to be
    small is broadcast; else a filter of its keys is, and only rows that pass it are
    shuffled."""
    n = sides.count()
    if n <= scratch.rows_that_may_be_broadcast():
        return rows.join(F.broadcast(sides), key)
    return passing(rows, key, sides, n).join(sides, key)
