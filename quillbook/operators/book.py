"""Questions about the book: levels, depth, queues, and the top at any message.

The top of book at every message is a merge of messages with level changes.  A busy
instrument would be one long merge, so every instrument's part of the stream is cut
into stretches of about ``STRETCH`` of its messages: the levels that stand where a
stretch begins are sums over the stretches before, carried in as rows, and stretches
are merged apart, in order, holding the levels of one instrument.  Rows grow with the
messages, and with the levels that stand at the few cuts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import scratch
from .lifecycle import is_book

#: Messages of an instrument after which a new stretch begins, and places of the stream
#: that are never parted: a stretch has fewer messages than both together.
STRETCH, CELL = 1 << 18, 1 << 20


def live_at(life: DataFrame, idx: int | None = None) -> DataFrame:
    """Orders live after message ``idx`` (None: at the end)."""
    if idx is None:
        return life.where("died IS NULL")
    return life.where((F.col("born") <= idx) & (F.col("died").isNull() | (F.col("died") > idx)))


def remaining(life: DataFrame, changed: DataFrame, idx: int | None = None) -> DataFrame:
    """Live orders with their remaining quantity, ``rem``."""
    cuts = changed if idx is None else changed.where(F.col("idx") <= idx)
    taken = cuts.where("NOT dies").groupBy("born").agg(F.sum("red").alias("taken"))
    return live_at(life, idx).join(taken, "born", "left").withColumn("rem", F.col("qty0") - F.coalesce("taken", F.lit(0))).drop("taken")


def depth(orders: DataFrame, levels: int | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """``scope, locate, side, rank, price, qty, orders``, best level first."""
    by_price = orders.groupBy(*scope, "locate", "side", "price").agg(F.sum("rem").alias("qty"), F.count("*").alias("orders"))
    best = Window.partitionBy(*scope, "locate", "side").orderBy(F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price")))
    out = by_price.withColumn("rank", F.row_number().over(best).cast("long"))
    out = out if levels is None else out.where(F.col("rank") <= levels)
    return out.select(*scope, "locate", "side", "rank", "price", "qty", "orders")


def queue(orders: DataFrame) -> DataFrame:
    """``locate, side, price, place, ref, rem``: first in, first out."""
    line = Window.partitionBy("locate", "side", "price").orderBy("born")
    return orders.select("locate", "side", "price", F.row_number().over(line).cast("long").alias("place"), "ref", "rem")


def find(life: DataFrame, changed: DataFrame, refs: DataFrame, idx: int | None = None) -> DataFrame:
    """The live orders among ``refs`` (a column ``ref``)."""
    return remaining(life, changed, idx).join(refs.select("ref").distinct(), "ref", "left_semi").select("ref", "locate", "side", "price", "rem")


def stretches(messages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, cell, stretch``: to which stretch of its instrument a cell of the stream
    belongs, where the instrument has book messages."""
    cells = messages.where(is_book()).groupBy(*keys, F.floor(F.col("idx") / CELL).alias("cell")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row per cell
    return cells.select(*keys, "cell", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / STRETCH).alias("stretch"))


def level_changes(life: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, idx, side, price, dq``: what births and effects do to levels."""
    births = life.select(*keys, F.col("born").alias("idx"), "side", "price", F.col("qty0").alias("dq"))
    cuts = changed.select(*keys, "idx", "side", "price", F.when(F.col("dies"), -F.col("before")).otherwise(-F.col("red")).alias("dq"))
    return births.unionByName(cuts)


class _Side:
    """Levels of one side; the best of them is looked for only after a change."""

    __slots__ = ("heap", "levels", "sign")

    def __init__(self, sign: int):
        self.sign, self.levels, self.heap = sign, {}, []

    def change(self, price: int, dq: int) -> None:
        qty = self.levels.get(price, 0) + dq
        if qty == 0:
            del self.levels[price]
        else:
            if price not in self.levels:
                heapq.heappush(self.heap, self.sign * price)
            self.levels[price] = qty

    def top(self) -> tuple[int, int]:
        while self.heap:
            price = self.sign * self.heap[0]
            if price in self.levels:
                return price, self.levels[price]
            heapq.heappop(self.heap)
        return 0, 0


TOP = ("bid_px", "bid_qty", "ask_px", "ask_qty")


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by group, ``idx`` and ``kind``: carried levels and changes move the
    levels, a message (kind 1) sees them ahead of its own changes and after them."""
    group = waiting = None
    out: list[tuple] = []
    for batch in batches:
        for own, idx, kind, side, price, dq in zip(*(batch[c].tolist() for c in ("group", "idx", "kind", "side", "price", "dq")), strict=True):
            if waiting is not None and (own != group or idx != waiting[0]):
                out.append((*waiting, *bids.top(), *asks.top()))
                waiting = None
            if own != group:
                group, bids, asks = own, _Side(-1), _Side(1)
            if kind == 1:
                waiting = (idx, *bids.top(), *asks.top())
            else:
                (bids if side == "B" else asks).change(price, dq)
        if out:
            yield pd.DataFrame(out, columns=["idx", *(f"before_{c}" for c in TOP), *TOP])
            out = []
    if waiting is not None:
        yield pd.DataFrame([(*waiting, *bids.top(), *asks.top())], columns=["idx", *(f"before_{c}" for c in TOP), *TOP])


def tops(messages: DataFrame, life: DataFrame, changed: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The top of each book message's own locate, ahead of it and after it: ``idx,
    before_bid_px, ..., bid_px, bid_qty, ask_px, ask_qty``; 0 where a side is empty."""
    keys = [*scope, "locate"]
    cut = scratch.table(stretches(messages, keys), "stretches")

    def placed(rows: DataFrame) -> DataFrame:
        # changes of a locate without book messages are seen by none
        return rows.withColumn("cell", F.floor(F.col("idx") / CELL)).join(scratch.small_side(cut), [*keys, "cell"]).drop("cell")

    # a message at the wrong locate changes the owner's book where that has no messages of its own
    changes = level_changes(life, changed, keys)
    cells = changes.select(*keys, F.floor(F.col("idx") / CELL).alias("cell")).distinct()
    every = cells.unionByName(cut.select(*keys, "cell")).distinct().join(cut, [*keys, "cell"], "left")
    upto = Window.partitionBy(*keys).orderBy("cell")
    cut = scratch.table(every.select(*keys, "cell", F.coalesce(F.max("stretch").over(upto), F.lit(0)).alias("stretch")), "stretches")
    changes = scratch.table(placed(changes), "level_changes")
    points = placed(messages.where(is_book()).select(*keys, "idx"))

    level = [*keys, "side", "price"]
    sums = changes.groupBy(*level, "stretch").agg(F.sum("dq").alias("dq"))
    at = Window.partitionBy(*level).orderBy("stretch")
    stands = sums.select(*level, F.col("stretch").alias("from"), F.lead("stretch").over(at).alias("next"), F.sum("dq").over(at).alias("dq"))
    last = cut.groupBy(*keys).agg(F.max("stretch").alias("last"))
    stands = stands.where("dq <> 0").join(last, keys).withColumn("to", F.coalesce("next", "last")).where(F.col("from") < F.col("to"))
    carried = stands.withColumn("stretch", F.explode(F.sequence(F.col("from") + 1, F.col("to")))).select(*level, "dq", "stretch")

    none = [F.lit(None).cast("string").alias("side"), F.lit(0).cast("long").alias("price"), F.lit(0).cast("long").alias("dq")]
    rows = carried.select(*keys, "stretch", F.lit(-1).cast("long").alias("idx"), F.lit(0).alias("kind"), "side", "price", "dq")
    rows = rows.unionByName(points.select(*keys, "stretch", "idx", F.lit(1).alias("kind"), *none))
    rows = rows.unionByName(changes.select(*keys, "stretch", "idx", F.lit(2).alias("kind"), "side", "price", "dq"))
    group = F.concat_ws("/", *[F.col(c).cast("string") for c in (*keys, "stretch")])
    rows = rows.select(group.alias("group"), "idx", "kind", "side", "price", "dq").repartition("group").sortWithinPartitions("group", "idx", "kind")
    schema = "idx long, " + ", ".join(f"{c} long" for c in (*(f"before_{c}" for c in TOP), *TOP))
    return rows.mapInPandas(_merge, schema)


def carried(rows: DataFrame, key: str, order: str, value: str, cell: int = 1 << 16) -> DataFrame:
    """``rows`` with the last ``value`` that is not null, of the same ``key``, at or before
    each: found within cells of the stream, and before them in the cells before."""
    dealt = rows.withColumn("_cell", F.floor(F.col(order) / cell))
    lasts = dealt.groupBy(key, "_cell").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row per cell
    lasts = lasts.select(key, "_cell", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy(key, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumn(value, F.last(value, ignorenulls=True).over(within)).join(lasts, [key, "_cell"])
    return met.withColumn(value, F.coalesce(value, "_carried")).select(*rows.columns)


def running_sum(steps: DataFrame, order: str, value: str, bucket: int = 1 << 16) -> DataFrame:
    """``steps`` with ``running``: sums within stretches of ``bucket`` places, and
    the totals of the stretches before.  Only the totals meet in one task."""
    dealt = steps.withColumn("_bucket", F.floor(F.col(order) / bucket))
    totals = dealt.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumn("running", F.sum(value).over(within)).join(scratch.small_side(bases), "_bucket")
    return met.withColumn("running", F.col("running") + F.col("_base")).drop("_bucket", "_base")


def previous(rows: DataFrame, order: str, value: str, bucket: int = 1 << 16) -> DataFrame:
    """``rows`` with ``prev``, the value of the row before in the whole stream: found
    within stretches, and for their first rows in the stretch before."""
    dealt = rows.withColumn("_bucket", F.floor(F.col(order) / bucket))
    lasts = dealt.groupBy("_bucket").agg(F.max_by(value, order).alias("_last"))
    carried = lasts.select("_bucket", F.lag("_last").over(Window.orderBy("_bucket")).alias("_carried"))
    within = Window.partitionBy("_bucket").orderBy(order)
    met = dealt.withColumn("prev", F.lag(value).over(within)).withColumn("_first", F.row_number().over(within) == 1)
    met = met.join(scratch.small_side(carried), "_bucket")
    return met.withColumn("prev", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("prev"))).drop("_bucket", "_first", "_carried")


def live_running(messages: DataFrame, life: DataFrame) -> DataFrame:
    """``idx, live`` after every book message."""
    births = life.select(F.col("born").alias("idx"), F.lit(1).alias("d"))
    deaths = life.where("died IS NOT NULL").select(F.col("died").alias("idx"), F.lit(-1).alias("d"))
    own = births.unionByName(deaths).groupBy("idx").agg(F.sum("d").alias("d"))
    steps = messages.where(is_book()).select("idx", "type").join(own, "idx", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    return running_sum(steps, "idx", "d").select("idx", "type", F.col("running").alias("live"))
