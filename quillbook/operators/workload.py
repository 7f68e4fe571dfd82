"""Characterisation of a stream: mix, rates, distances, lifetimes, depth over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import histogram as H
from ..plans import scratch
from .book import carried, previous
from .lifecycle import is_book

NS = 1_000_000_000
OPEN, CLOSE = 34_200 * NS, 57_600 * NS
#: Distances up to which coverage is stated.
WITHIN = (0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 16384)


def tick_of(price: Column) -> Column:
    """100 from one dollar on, else 1 (four implied decimals)."""
    return F.when(price >= 10_000, F.lit(100)).otherwise(F.lit(1))


def regular(ts: Column) -> Column:
    return (ts >= OPEN) & (ts < CLOSE)


def message_mix(messages: DataFrame) -> DataFrame:
    return messages.groupBy("type").agg(F.count("*").alias("n"))


def trading_state(messages: DataFrame) -> DataFrame:
    """``messages`` with ``state`` as of each message: the last action at its locate."""
    return carried(messages, "locate", "idx", "state")


def crossings(tops: DataFrame, states: DataFrame) -> DataFrame:
    """``tops`` with ``state``, ``bucket`` (0 outside hours, 1 trading, 2 not) and the
    flags ``crossed`` and ``locked``."""
    two = (F.col("bid_qty") != 0) & (F.col("ask_qty") != 0)
    met = tops.join(states.select("idx", "state"), "idx")
    bucket = F.when(~regular(F.col("ts_ns")), 0).when(F.col("state") == "T", 1).otherwise(2)
    return met.withColumns({"bucket": bucket, "crossed": two & (F.col("bid_px") > F.col("ask_px")), "locked": two & (F.col("bid_px") == F.col("ask_px"))})


def invariant_buckets(crossed: DataFrame) -> DataFrame:
    return crossed.groupBy("bucket").agg(F.count("*").alias("checks"), F.count_if("crossed").alias("crossed"), F.count_if("locked").alias("locked"))


def crossed_events(crossed: DataFrame, cap: int = 100_000) -> DataFrame:
    """The first ``cap`` messages after which a book was crossed or locked."""
    rows = crossed.where(F.col("crossed") | F.col("locked")).orderBy("idx").limit(cap)
    return rows.select("idx", "ts_ns", "locate", "type", F.coalesce("state", F.lit("-")).alias("state"), "bid_px", "bid_qty", "ask_px", "ask_qty")


def distances(messages: DataFrame, effects: DataFrame, before: DataFrame) -> DataFrame:
    """``kind, way, ticks`` of every price against the best of its side ahead of the
    message: ``behind`` (or at), ``improve``, or ``no_best`` with null ticks."""
    kind = F.when(F.col("type").isin("E", "C"), "executed").when(F.col("type") == "X", "cancelled").when(F.col("type") == "D", "deleted").otherwise("replaced")
    adds = messages.where(F.col("type").isin("A", "F")).select("idx", F.lit("add").alias("kind"), "side", "price")
    old = effects.select("idx", kind.alias("kind"), "side", "price")
    new = effects.where("type = 'U'").select("idx", "side").join(messages.where("type = 'U'").select("idx", "price"), "idx")
    asked = adds.unionByName(old).unionByName(new.select("idx", F.lit("replace_new").alias("kind"), "side", "price"))
    met = asked.join(before.select("idx", "bid_px", "bid_qty", "ask_px", "ask_qty"), "idx")
    best = F.when(F.col("side") == "B", F.when(F.col("bid_qty") != 0, F.col("bid_px"))).otherwise(F.when(F.col("ask_qty") != 0, F.col("ask_px")))
    diff = F.when(F.col("side") == "B", best - F.col("price")).otherwise(F.col("price") - best)
    way = F.when(best.isNull(), "no_best").when(diff >= 0, "behind").otherwise("improve")
    return met.select("kind", way.alias("way"), F.floor(F.abs(diff) / tick_of(best)).alias("ticks"))


def coverage(hist: DataFrame) -> DataFrame:
    """``kind, within, n, all``: how many distances lie in buckets wholly within each bound."""
    bounds = F.explode(F.array(*map(F.lit, WITHIN))).alias("within")
    inside = F.sum(F.when(H.highest_of(F.col("bucket")) <= F.col("within"), F.col("n")).otherwise(0))
    return hist.select("kind", "bucket", "n", bounds).groupBy("kind", "within").agg(inside.cast("long").alias("n"), F.sum("n").cast("long").alias("all"))


def elapsed(messages: DataFrame, life: DataFrame) -> DataFrame:
    """``end_kind, days, lifetime`` of every dead order, whichever session it died in:
    the days between its sessions, and nanoseconds that include them."""
    ends = messages.select(F.col("idx").alias("died"), F.col("session").alias("died_session"))
    met = life.where("died IS NOT NULL").join(ends, "died").withColumn("days", F.datediff("died_session", "session").cast("long"))
    return met.select("end_kind", "days", (F.col("days") * (86_400 * NS) + F.col("died_ns") - F.col("born_ns")).alias("lifetime"))


def rate_windows(messages: DataFrame, width: int) -> DataFrame:
    """``session, win, n`` of the windows of regular hours that have messages."""
    rows = messages.where(regular(F.col("ts_ns")))
    return rows.groupBy("session", F.floor((F.col("ts_ns") - OPEN) / width).alias("win")).agg(F.count("*").alias("n"))


def rate_histogram(windows: DataFrame, width: int) -> DataFrame:
    """``bucket, n`` of the windows' counts; empty windows of a session count as 0."""
    full = windows.groupBy(H.bucket_of(F.col("n")).alias("bucket")).agg(F.count("*").alias("n"))
    empty = windows.groupBy("session").agg((F.lit((CLOSE - OPEN) // width) - F.count("*")).alias("n"))
    zeros = empty.agg(F.sum("n").alias("n")).where("n > 0").select(F.lit(0).cast("long").alias("bucket"), "n")
    return full.unionByName(zeros).groupBy("bucket").agg(F.sum("n").cast("long").alias("n"))


def snapshot_cuts(messages: DataFrame) -> DataFrame:
    """``session, boundary_s, cut``: the first message at or past every half hour."""
    bounds = F.explode(F.sequence(*(F.lit(x).cast("long") for x in (OPEN // NS, CLOSE // NS, 1800)))).alias("boundary_s")
    rows = messages.groupBy("session", F.floor(F.col("ts_ns") / (1800 * NS)).alias("half")).agg(F.min("idx").alias("first"))
    # the stream of a session is ordered by time, so the first message of a later half hour is the answer
    sessions = rows.select("session").distinct().select("session", bounds)
    met = sessions.join(rows, "session").where(F.col("half") * 1800 >= F.col("boundary_s"))
    return met.groupBy("session", "boundary_s").agg(F.min("first").alias("cut"))


def _cuts_seen(messages: DataFrame, cuts: DataFrame, cell: int = 1 << 16) -> DataFrame:
    """``cell, base, cuts``: for every cell of the stream, how many cuts lie in the cells
    before, and those in it."""
    last = messages.agg(F.max("idx")).first()[0] or 0
    cells = messages.sparkSession.range(0, last // cell + 1).withColumnRenamed("id", "cell")
    own = cuts.groupBy(F.floor(F.col("cut") / cell).alias("cell")).agg(F.collect_list("cut").alias("cuts"))  # 14 a session
    met = cells.join(own, "cell", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for 65,536 messages
    return met.select("cell", F.coalesce(F.sum(F.size("cuts")).over(before), F.lit(0)).alias("base"), "cuts")


def _seen(rows: DataFrame, at: str, seen: DataFrame, name: str, cell: int = 1 << 16) -> DataFrame:
    """``rows`` with the number of cuts at or before their ``at``."""
    met = rows.withColumn("cell", F.floor(F.col(at) / cell)).join(scratch.small_side(seen), "cell", "left")
    inside = F.size(F.filter("cuts", lambda c: c <= F.col(at)))
    return met.withColumn(name, (F.col("base") + inside).cast("long")).drop("cell", "base", "cuts")


#: ``boundary_s`` of the last snapshot, at the end of the stream.
END_S = 86_400


def depth_snapshots(messages: DataFrame, life: DataFrame) -> DataFrame:
    """Books just before each half hour of each session, and at the end of the stream
    (``boundary_s`` 86,400 of the last session): live orders, sides, and the distribution
    of levels per side and of orders per level.

    Cuts are numbered in stream order; those that see an order live are the range
    of numbers between its birth and its death."""
    cuts = scratch.table(snapshot_cuts(messages), "cuts")
    number = Window.orderBy("cut", "session", "boundary_s")  # 14 rows a session
    numbered = cuts.select(F.row_number().over(number).cast("long").alias("k"), F.col("session").alias("at_session"), "boundary_s")
    n = cuts.count()
    final = messages.agg(F.max_by("session", "idx").alias("at_session"))
    numbered = numbered.unionByName(final.select(F.lit(n + 1).cast("long").alias("k"), "at_session", F.lit(END_S).cast("long").alias("boundary_s")))
    seen = scratch.table(_cuts_seen(messages, cuts), "seen")
    spans = _seen(_seen(life.select("born", "died", "locate", "side", "price"), "born", seen, "from"), "died", seen, "to")
    spans = spans.withColumn("to", F.coalesce("to", F.lit(n + 1)))
    live = spans.where(F.col("from") < F.col("to")).withColumn("k", F.explode(F.sequence(F.col("from") + 1, F.col("to"))))
    live = live.join(scratch.small_side(numbered), "k")
    at = ["at_session", "boundary_s"]
    levels = scratch.table(live.groupBy(*at, "locate", "side", "price").agg(F.count("*").alias("orders")), "levels")
    sides = levels.groupBy(*at, "locate", "side").agg(F.count("*").alias("levels"))
    shares = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    per_side = H.quantiles(H.histogram(sides, F.col("levels"), *at), shares, *at).drop("mean")
    per_side = per_side.select(*at, F.col("n").alias("sides"), *[F.col(c).alias(f"levels_{c}") for c in (*shares, "max")])
    per_level = H.quantiles(H.histogram(levels, F.col("orders"), *at), {"p50": 0.5, "p99": 0.99}, *at)
    per_level = per_level.select(*at, *[F.col(c).alias(f"orders_{c}") for c in ("p50", "p99", "max")])
    total = levels.groupBy(*at).agg(F.sum("orders").alias("live_orders"))
    return total.join(per_side, at).join(per_level, at).withColumnRenamed("at_session", "session")


def symbol_activity(messages: DataFrame, life: DataFrame) -> DataFrame:
    """``locate, n, low, high, range_ticks`` of every locate with book messages; prices
    are those of orders that came to be."""
    counted = messages.where(is_book()).groupBy("locate").agg(F.count("*").alias("n"))
    made = messages.where(F.col("type").isin("A", "F", "U")).select("idx", "locate").join(life.select(F.col("born").alias("idx"), "price"), "idx")
    prices = made.groupBy("locate").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    met = counted.join(prices, "locate", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("low", "high")})
    ticks = F.when(F.col("low") == 0, F.lit(0)).otherwise(F.floor((F.col("high") - F.col("low")) / tick_of(F.col("low"))))
    return met.withColumn("range_ticks", ticks.cast("long"))


def top_symbols(messages: DataFrame, k: int) -> DataFrame:
    counted = messages.where(is_book()).groupBy("locate").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "locate").limit(k)


def symbol_share(activity: DataFrame, ranks: tuple[int, ...] = (10, 100, 1000)) -> DataFrame:
    """``top, n, all``: messages of the most active locates."""
    total = activity.agg(F.sum("n").alias("all"))
    parts = None
    for k in ranks:
        top = activity.orderBy(F.desc("n"), "locate").limit(k).agg(F.sum("n").alias("n")).select(F.lit(k).cast("long").alias("top"), F.col("n").cast("long").alias("n"))
        parts = top if parts is None else parts.unionByName(top)
    return parts.crossJoin(F.broadcast(total.select(F.col("all").cast("long"))))  # one row of totals


def ref_density(life: DataFrame) -> DataFrame:
    return life.agg(
        F.count("*").alias("n"), F.min("ref").alias("low"), F.max("ref").alias("high"),
        (F.count("*") / (F.max("ref") - F.min("ref") + 1)).alias("density"),
    )


def regressions(messages: DataFrame) -> DataFrame:
    met = previous(messages.select("idx", "ts_ns"), "idx", "ts_ns")
    return met.agg(F.count_if(F.col("ts_ns") < F.col("prev")).alias("regressions"))


def gaps(messages: DataFrame) -> DataFrame:
    """Places where the order ``idx`` leaves a hole: ``after, missing``."""
    met = previous(messages.select("idx", F.col("idx").alias("own")), "idx", "own")
    return met.where("prev IS NOT NULL AND idx <> prev + 1").select(F.col("prev").alias("after"), (F.col("idx") - F.col("prev") - 1).alias("missing"))
