"""The book and the strategy over a stream of messages, with keyed state.

State is kept by locate in the state store: live orders, and the strategy's position
and last order.  Messages of a locate must arrive in the order of ``idx`` over
micro-batches; within one they are sorted.  The batch plans and this one give the
same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.decide import BUY, SELL, Strategy
from ..operators.fold import Book
from ..operators.lifecycle import LOCATES, is_book
from ..plans import scratch

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = (
    "idx long, locate int, type string, outcome string, bid_px long, bid_qty long, ask_px long, ask_qty long, action int, order_price long, order_qty int"
)


def configure(spark: SparkSession) -> None:
    """State that may exceed memory belongs in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class BookProcessor(StatefulProcessor):
    def __init__(self, strategy: Strategy = Strategy(), locates: int | None = LOCATES):
        self.strategy, self.locates = strategy, locates

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.orders = handle.getMapState("orders", "ref long", "side string, price long, qty long")
        self.account = handle.getValueState("account", "position int, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        locate, book, before = int(key[0]), Book(self.locates), set()
        for (ref,), (side, price, qty) in self.orders.iterator():
            book._grow(int(ref), locate, side, int(price), int(qty))
            before.add(int(ref))
        position, last = self.account.get() if self.account.exists() else (0, 0)
        cfg, out = self.strategy, []
        changed: set[int] = set()
        for r in pd.concat(list(rows)).sort_values("idx").itertuples(index=False):
            outcome, _ = book.apply(r.type, locate, r.ref, r.new_ref, r.side, r.shares, r.price)
            changed |= {r.ref, r.new_ref}
            bid, bid_qty, ask, ask_qty = top = book.top(locate)
            action = None
            if bid_qty and ask_qty and 0 < ask - bid <= cfg.max_spread:
                action = BUY if bid_qty >= cfg.ratio * ask_qty else SELL if ask_qty >= cfg.ratio * bid_qty else None
            if action and not (last and r.idx + 1 - last < cfg.cooldown):
                after = position + (cfg.order_qty if action == BUY else -cfg.order_qty)
                if abs(after) <= cfg.max_position:
                    position, last = after, r.idx + 1
                else:
                    action = None
            else:
                action = None
            price = ask if action == BUY else bid if action == SELL else None
            out.append((r.idx, locate, r.type, outcome, *top, action, price, cfg.order_qty if action else None))
        for ref in changed | before:
            if ref in book.orders:
                if ref in changed:
                    self.orders.updateValue((ref,), tuple(book.orders[ref][1:]))
            elif ref in before:
                self.orders.removeKey((ref,))
        self.account.update((int(position), int(last)))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
        yield frame.astype({"action": "Int32", "order_price": "Int64", "order_qty": "Int32"})

    def close(self) -> None:
        pass


def book_stream(messages: DataFrame, strategy: Strategy = Strategy(), locates: int | None = LOCATES) -> DataFrame:
    """A streaming (or batch) table of messages to a row per book message."""
    configure(messages.sparkSession)
    none = F.lit(0).cast("long")
    rows = messages.where(is_book()).select(
        "idx", "locate", "type", *[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("ref", "new_ref")], F.coalesce("side", F.lit("S")).alias("side"),
        *[F.coalesce(c, none).alias(c) for c in ("shares", "price")],
    )
    return rows.groupBy("locate").transformWithStateInPandas(BookProcessor(strategy, locates), RESULT, "Append", "None")


def rate_stream(messages: DataFrame, width: str = "1 second", late: str = "0 seconds") -> DataFrame:
    """Messages per tumbling window of event time (``session`` and ``ts_ns``); windows
    close as the watermark passes them.  Spark's timestamps have microseconds: only
    the windows use them, never the order of messages."""
    at = F.timestamp_micros(F.unix_micros(F.col("session").cast("timestamp")) + F.floor(F.col("ts_ns") / 1000))
    timed = messages.select(at.alias("at")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def replayed(messages: DataFrame, triggers: int = 2, strategy: Strategy = Strategy(), locates: int | None = LOCATES) -> DataFrame:
    """The result of streaming a finished table through ``book_stream``: it is cut into
    ``triggers`` stretches of the order, and each is a micro-batch that starts from the
    state the one before left."""
    spark = messages.sparkSession
    base = f"{scratch.folder(spark)}/replay-{uuid.uuid4().hex}"
    end = (messages.agg(F.max("idx")).first()[0] or 0) + 1
    for k in range(triggers):
        low, high = end * k // triggers, end * (k + 1) // triggers
        messages.where((F.col("idx") >= low) & (F.col("idx") < high)).write.mode("append").parquet(f"{base}/in")
        live = spark.readStream.schema(messages.schema).parquet(f"{base}/in")
        out = book_stream(live, strategy, locates)
        writer = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")
