"""Synthetic streams: deterministic by seed, in eight modes.

Distributions, not bytes, are what a mode promises.  ``stream`` generates symbols
apart, so that a large stream is made by many tasks, and interleaves them by time.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MODES = ("realistic", "deep-queue", "wide-prices", "replace-chains", "crossing", "many-symbols", "error-paths", "mixed")
KINDS = ("A", "E", "C", "X", "D", "U", "P")
# Shares of adds, executions, priced executions, cancels, deletes, replacements and trades, in percent.
MIX = {
    "realistic": (44, 4, 0.5, 3, 38, 9, 1.5),
    "deep-queue": (50, 4, 0, 4, 40, 2, 0),
    "replace-chains": (20, 2, 0, 2, 6, 70, 0),
}
ELSEWHERE = "~"  # marks a fault that is sent at another locate
START_NS = 4 * 3600 * 10**9
SCHEMA = (
    "idx long, session date, ts_ns long, type string, locate int, ref long, new_ref long, side string, shares long, price long, state string"
)


@dataclass(frozen=True)
class Fixture:
    mode: str = "realistic"
    seed: int = 1
    messages: int = 100_000
    symbols: int = 50


class _Symbol:
    """The stream of one symbol: ``(ts_ns, type, ref, new_ref, side, shares, price)``."""

    def __init__(self, mode: str, seed: int, locate: int):
        self.mode, self.rng = mode, random.Random(f"{mode}/{seed}/{locate}")
        self.live: dict[int, list] = {}
        self.refs: list[int] = []
        self.next, self.ts, self.locate = 0, START_NS, locate
        self.middle = int(math.exp(self.rng.uniform(math.log(5_000), math.log(5_000_000))))

    def ref(self) -> int:
        self.next += self.rng.randint(1, 4)
        return self.next << 16 | self.locate  # unique among symbols

    def price(self, side: str) -> int:
        rng, tick = self.rng, 100 if self.middle >= 10_000 else 1
        away = 1 if self.mode == "deep-queue" else int(math.exp(rng.uniform(0, math.log(20_000)))) if self.mode == "wide-prices" else min(200, int(rng.expovariate(0.1)) + 1)
        if self.mode == "crossing" and rng.random() < 0.05:
            away = -away
        return max(tick, self.middle + (-away if side == "B" else away) * tick)

    def shares(self) -> int:
        return self.rng.randint(1, 99) if self.rng.random() < 0.15 else 100 * self.rng.randint(1, 10)

    def pick(self) -> int | None:
        while self.refs:
            at = self.rng.randrange(len(self.refs))
            if self.refs[at] in self.live:
                return self.refs[at]
            self.refs[at] = self.refs[-1]
            self.refs.pop()
        return None

    def born(self, ref: int, side: str, shares: int, price: int) -> None:
        self.live[ref] = [side, shares, price]
        self.refs.append(ref)

    def fault(self) -> tuple:
        """A message that a sound stream never has."""
        rng, ghost, some = self.rng, self.ref() + (1 << 48), self.pick()
        kind = rng.choice("EXDUoadzq")
        if kind in "EXDU":
            return kind, ghost, ghost + 1 if kind == "U" else None, None, 0 if kind == "D" else 100, self.middle if kind == "U" else None
        if kind == "o" and some is not None:
            over = self.live.pop(some)[1] + 7
            return "E", some, None, None, over, None
        if kind == "a" and some is not None:
            return "A", some, None, "B", 100, self.middle
        if kind == "d" and some is not None:  # at the wrong locate: the order's own book moves
            order = self.live[some]
            cut = min(order[1], 1)
            order[1] -= cut
            if order[1] == 0:
                del self.live[some]
            return ELSEWHERE + "X", some, None, None, cut, None
        if kind == "z":
            return "z", None, None, None, None, None
        return "A", self.ref(), None, "B", 0, self.middle

    def step(self) -> tuple:
        rng = self.rng
        self.ts += rng.randint(1, 2000)
        if self.mode == "error-paths" and rng.random() < 0.05:
            return (self.ts, *self.fault())
        kind = rng.choices(KINDS, MIX.get(self.mode, MIX["realistic"]))[0]
        ref = None if kind in "AP" else self.pick()
        if kind == "P":
            return self.ts, "P", None, None, None, None, None
        if ref is None:
            ref, side, shares = self.ref(), rng.choice("BS"), self.shares()
            price = self.price(side)
            self.born(ref, side, shares, price)
            return self.ts, "F" if rng.random() < 0.1 else "A", ref, None, side, shares, price
        order = self.live[ref]
        if kind == "D" or kind == "X" and order[1] == 1:
            del self.live[ref]
            return self.ts, "D", ref, None, None, 0, None
        if kind == "U":
            side, _, old = self.live.pop(ref)
            new, shares, price = self.ref(), self.shares(), old if rng.random() < 0.5 else self.price(side)
            self.born(new, side, shares, price)
            return self.ts, "U", ref, new, side, shares, price
        cut = rng.randint(1, order[1] - 1) if kind == "X" else order[1] if rng.random() < 0.5 else rng.randint(1, order[1])
        order[1] -= cut
        if order[1] == 0:
            del self.live[ref]
        return self.ts, kind, ref, None, None, cut, None


RAW = "part int, step int, ts_ns long, type string, locate int, ref long, new_ref long, side string, shares long, price long, state string"
#: Tasks among which symbols are dealt.
TASKS = 64


def _symbols(fixture: Fixture) -> list[tuple[int, str, int, int]]:
    """``part, mode, locate, messages`` of every symbol."""
    modes, plan = MODES[:-1] if fixture.mode == "mixed" else (fixture.mode,), []
    for part, mode in enumerate(modes):
        symbols = fixture.symbols * (20 if mode == "many-symbols" else 1)
        weights = [1 if mode == "many-symbols" else 1 / (k + 1) for k in range(symbols)]
        for k in range(symbols):
            plan.append((part, mode, part * 4096 + k + 1, max(1, round(fixture.messages / len(modes) * weights[k] / sum(weights)))))
    return plan


def _generated(part: int, mode: str, locate: int, n: int, seed: int) -> Iterator[tuple]:
    """The rows of one symbol: a directory and a trading message, then its stream."""
    symbol = _Symbol(mode, seed, locate)
    yield part, -2, START_NS, "R", locate, *[None] * 6
    yield part, -1, START_NS, "H", locate, *[None] * 5, "T"
    for k in range(n):
        ts, kind, *rest = symbol.step()
        yield part, k, ts, kind.removeprefix(ELSEWHERE), locate % 65_535 + 1 if kind.startswith(ELSEWHERE) else locate, *rest, None


@dataclass
class _Share(InputPartition):
    symbols: list


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        given = {k: int(options[k]) for k in ("seed", "messages", "symbols") if k in options}
        self.fixture = Fixture(options.get("mode", "realistic"), **given)
        if self.fixture.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}, not {self.fixture.mode}")

    def partitions(self) -> list[_Share]:
        plan = sorted(_symbols(self.fixture), key=lambda s: -s[3])  # the longest are dealt first
        return [_Share(plan[k::TASKS]) for k in range(min(TASKS, len(plan)))]

    def read(self, partition: _Share) -> Iterator[tuple]:
        for symbol in partition.symbols:
            yield from _generated(*symbol, self.fixture.seed)


class SyntheticSource(DataSource):
    """``format("synthetic")``: options ``mode``, ``seed``, ``messages`` and ``symbols``; rows
    in the order of each symbol (``step``) only, which ``stream`` interleaves."""

    @classmethod
    def name(cls) -> str:
        return "synthetic"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def stream(spark: SparkSession, fixture: Fixture = Fixture()) -> DataFrame:
    """The messages of a fixture, with a directory and a trading message per symbol.
    Symbol k gets a share in proportion to 1 / (k + 1); ``many-symbols`` has twenty
    times the symbols with equal shares, and ``mixed`` runs the other modes one after
    another."""
    spark.dataSource.register(SyntheticSource)
    options = {"mode": fixture.mode, "seed": fixture.seed, "messages": fixture.messages, "symbols": fixture.symbols}
    made = spark.read.format("synthetic").options(**options).load()
    # a total order: parts, then time, then symbol
    dealt = made.withColumn("second", F.floor(F.col("ts_ns") / 10**6))
    sizes = dealt.groupBy("part", "second").agg(F.count("*").alias("n"))
    before = Window.orderBy("part", "second").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "second", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part", "second").orderBy("ts_ns", "locate", "step")
    met = dealt.withColumn("at", F.row_number().over(within) - 1).join(bases, ["part", "second"])
    return met.select(
        (F.col("base") + F.col("at")).alias("idx"), F.lit("2024-01-01").cast("date").alias("session"), "ts_ns", "type", "locate", "ref", "new_ref", "side",
        "shares", "price", "state",
    )
