"""The imbalance strategy: signals, orders under risk limits, and their digest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# The strategy's defaults.
@dataclass(frozen=True)
class Strategy:
    ratio: int = 4
    max_spread: int = 500
    order_qty: int = 100
    max_position: int = 1000
    cooldown: int = 1000


BUY, SELL = 1, 2


def signals(tops: DataFrame, strategy: Strategy = Strategy()) -> DataFrame:
    """``idx, locate, action, price, qty``: messages after which one side of a tight,
    uncrossed book outweighs the other.  Buying is asked first."""
    open_ = (F.col("bid_qty") != 0) & (F.col("ask_qty") != 0) & (F.col("ask_px") > F.col("bid_px"))
    tight = F.col("ask_px") - F.col("bid_px") <= strategy.max_spread
    buy = F.col("bid_qty") >= strategy.ratio * F.col("ask_qty")
    sell = F.col("ask_qty") >= strategy.ratio * F.col("bid_qty")
    rows = tops.where(open_ & tight & (buy | sell))
    return rows.select(
        "idx", "locate", F.when(buy, BUY).otherwise(SELL).alias("action"), F.when(buy, F.col("ask_px")).otherwise(F.col("bid_px")).alias("price"),
        F.lit(strategy.order_qty).alias("qty"),
    )


def orders(found: DataFrame, strategy: Strategy = Strategy()) -> DataFrame:
    """The signals that become orders.  Per locate, in stream order: none within
    ``cooldown`` messages of the last order (every message of the stream counts),
    none past the position limit; a blocked order starts no cool-down.

    Rows arrive sorted by locate and index and are folded as they stream through, so
    state is one position and one index, however many signals a locate has."""
    cfg = strategy

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        locate, position, last = None, 0, 0
        for batch in batches:
            kept = []
            for at, (own, idx, action) in enumerate(zip(batch["locate"], batch["idx"], batch["action"], strict=True)):
                if own != locate:
                    locate, position, last = own, 0, 0
                number = idx + 1
                if last and number - last < cfg.cooldown:
                    continue
                after = position + (cfg.order_qty if action == BUY else -cfg.order_qty)
                if abs(after) > cfg.max_position:
                    continue
                position, last = after, number
                kept.append(at)
            yield batch.iloc[kept]

    return found.repartition("locate").sortWithinPartitions("locate", "idx").mapInPandas(fold, found.schema)


# Offset basis, prime and width of the digest.
_BASIS, _PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def digest_row(decided: DataFrame) -> DataFrame:
    """``digest, orders``: FNV-1a over (locate, action, price, qty) of the orders in stream
    order, 16 hex digits, and their number.  The function has no way to be combined, so
    one task folds the orders; they are sorted by the cluster and stream through it."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value, n = _BASIS, 0
        for batch in batches:
            for row in zip(*(batch[c].tolist() for c in ("locate", "action", "price", "qty")), strict=True):
                n += 1
                for byte in b"".join(int(field).to_bytes(8, "little") for field in row):
                    value = ((value ^ byte) * _PRIME) & _MASK
        yield pd.DataFrame({"digest": [f"{value:016x}"], "orders": [n]})

    ordered = decided.select("idx", "locate", "action", "price", "qty").repartition(1).sortWithinPartitions("idx")
    folded = ordered.mapInPandas(fold, "digest string, orders long")
    # one row even where nothing was decided
    return folded.agg(F.coalesce(F.max("digest"), F.lit(f"{_BASIS:016x}")).alias("digest"), F.coalesce(F.max("orders"), F.lit(0)).cast("long").alias("orders"))


def digest(decided: DataFrame) -> tuple[str, int]:
    return tuple(digest_row(decided).first())
