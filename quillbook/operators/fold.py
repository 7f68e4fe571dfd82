"""The book as a state machine over messages in order: exact for every anomaly.

Where references are unique and locates consistent, books are independent and the
fold runs per locate; else one reference can move another locate's book, and a day is
folded as one.  Rows stream through sorted, so a task holds the live
orders of one book, never a group of messages.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lifecycle import LOCATES, is_book

OUTCOMES = (
    "applied", "unknown_ref", "duplicate_ref", "zero_qty", "bad_locate", "overfill",
)


class Book:
    """Books of any number of locates; ``apply`` returns the outcome of a message."""

    def __init__(self, locates: int | None = LOCATES):
        self.locates = locates
        self.orders: dict[int, list] = {}  # ref -> locate, side, price, qty
        self.levels: dict[tuple, list[int]] = {}  # locate, side, price -> qty, orders
        self.best: dict[tuple, list[int]] = {}  # locate, side -> heap of prices, stale ones included

    def _grow(self, ref: int, locate: int, side: str, price: int, qty: int) -> None:
        self.orders[ref] = [locate, side, price, qty]
        level = self.levels.get((locate, side, price))
        if level is None:
            self.levels[locate, side, price] = [qty, 1]
            heapq.heappush(self.best.setdefault((locate, side), []), -price if side == "B" else price)
        else:
            level[0] += qty
            level[1] += 1

    def _shrink(self, ref: int, qty: int | None) -> None:
        order = self.orders[ref]
        gone = qty is None or qty >= order[3]
        taken = order[3] if gone else qty
        key = tuple(order[:3])
        level = self.levels[key]
        level[0] -= taken
        order[3] -= taken
        if gone:
            level[1] -= 1
            del self.orders[ref]
            if level[1] == 0:
                del self.levels[key]

    def _add(self, ref, locate, side, price, qty) -> str:
        if qty <= 0:
            return "zero_qty"
        if ref in self.orders:
            return "duplicate_ref"
        self._grow(ref, locate, side, price, qty)
        return "applied"

    def apply(self, kind: str, locate: int, ref: int, new_ref: int, side: str, qty: int, price: int) -> tuple[str, bool]:
        """The outcome, and whether the locate differs from the order's own."""
        if kind in "AF":
            if self.locates is not None and not 0 <= locate < self.locates:
                return "bad_locate", False
            return self._add(ref, locate, side, price, qty), False
        order = self.orders.get(ref)
        if order is None:
            return "unknown_ref", False
        moved = order[0] != locate
        if kind in "ECX":
            over = qty > order[3]
            self._shrink(ref, qty)
            return "overfill" if over else "applied", moved
        owner, own_side = order[0], order[1]
        self._shrink(ref, None)
        if kind == "U":
            return self._add(new_ref, owner, own_side, price, qty), moved
        return "applied", moved

    def side_top(self, locate: int, side: str) -> tuple[int, int]:
        heap, sign = self.best.get((locate, side), []), -1 if side == "B" else 1
        while heap and (locate, side, sign * heap[0]) not in self.levels:
            stale = heapq.heappop(heap)
            while heap and heap[0] == stale:
                heapq.heappop(heap)
        if not heap:
            return 0, 0
        price = sign * heap[0]
        return price, self.levels[locate, side, price][0]

    def top(self, locate: int) -> tuple[int, int, int, int]:
        return (*self.side_top(locate, "B"), *self.side_top(locate, "S"))


_RESULT = (
    "idx long, locate int, type string, outcome string, mismatch boolean, bid_px long, bid_qty long, ask_px long, ask_qty long, live long"
)


def _replay(by: Sequence[str], locates: int | None):
    names = [x.split()[0] for x in _RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, current = Book(locates), None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (own := tuple(getattr(r, c) for c in by)) != current:
                    book, current = Book(locates), own
                outcome, moved = book.apply(r.type, r.locate, r.ref, r.new_ref, r.side, r.shares, r.price)
                out.append((r.idx, r.locate, r.type, outcome, moved, *book.top(r.locate), len(book.orders)))
            yield pd.DataFrame(out, columns=names)

    return run


def replay(messages: DataFrame, by: Sequence[str] = ("locate",), locates: int | None = LOCATES) -> DataFrame:
    """A row per book message: its outcome, whether its locate is not the order's, the
    top of its locate after it, and the live orders (of its book).  ``by`` names the
    columns within which references count and books are apart: ``("session",)`` for days
    in which references cross locates; ``()`` keeps one state for the whole stream, in
    one task."""
    none = F.lit(0).cast("long")
    rows = messages.where(is_book()).select(
        *[c for c in by if c != "locate"], "idx", "locate", "type", *[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("ref", "new_ref")], F.coalesce("side", F.lit("S")).alias("side"),
        *[F.coalesce(c, none).alias(c) for c in ("shares", "price")],
    )
    dealt = rows.repartition(*by).sortWithinPartitions(*by, "idx") if by else rows.coalesce(1).sortWithinPartitions("idx")
    return dealt.mapInPandas(_replay(tuple(by), locates), _RESULT)


def counters(replayed: DataFrame) -> DataFrame:
    """The eleven counters, from the outcomes."""
    kind, out = F.col("type"), F.col("outcome")
    return replayed.agg(
        F.count_if(kind.isin("A", "F")).alias("adds"), F.count_if(kind.isin("E", "C")).alias("executes"), F.count_if(kind == "X").alias("cancels"),
        F.count_if(kind == "D").alias("deletes"), F.count_if(kind == "U").alias("replaces"),
        *[F.count_if(out == c).alias(c) for c in ("unknown_ref", "duplicate_ref", "overfill")],
        F.count_if("mismatch").alias("locate_mismatch"), *[F.count_if(out == c).alias(c) for c in ("bad_locate", "zero_qty")],
    )
