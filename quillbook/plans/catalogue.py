"""The queries of the engine over a data folder, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, text
from ..functions import histogram as H
from ..operators import book, decide, diff, directory, feed, fold, lifecycle, stats, views, workload
from ..sources import framed, sinks
from ..streaming import book_stream
from . import oracle as O
from . import scratch
from .session import Stream, stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

QUIET = 50  # a shorter cool-down than the strategy's own, under which more orders pass
FEED = workload.OPEN  # start of the measured window, which lasts to the end
RATE = 250_000.0


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _on(view: str = "events"):
    """The rest of a query that only needs a stream."""
    def wrap(f: Callable[[Stream], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(stream(spark, sf_dir, view))

        run.__name__ = f.__name__
        return run

    return wrap


# -- messages ------------------------------------------------------------------


@query(O.on_events("SELECT type, count(*) AS n FROM m GROUP BY type"))
@_on()
def message_mix(s):
    return workload.message_mix(s.messages)


_WIRE_SIDE = "CASE WHEN type = 'A' THEN side END AS side"  # replacements carry none
_ROUND = ["idx", "type", "locate", "ts_ns", "ref", "new_ref", "side", "shares", "price", "state"]


@query(O.on_events(f"SELECT {', '.join(_ROUND).replace('side', _WIRE_SIDE)} FROM m WHERE type IN ('A', 'E', 'X', 'D', 'U', 'H') AND (ref IS NOT NULL OR type IN ('A', 'H'))"))
@_on()
def decode_roundtrip(s):
    """Encoding, then decoding, gives the messages back."""
    rows = s.messages.where(F.col("type").isin("A", "E", "X", "D", "U", "H") & (F.col("ref").isNotNull() | F.col("type").isin("A", "H")))
    got = codec.decoded(F.col("body"))
    return _whole_locates(rows.select("idx", _body().alias("body")).select("idx", got["tracking"], *[got[c] for c in _ROUND[1:]])).select(*_ROUND)


def _body():
    """The body of a message of a stream, whose locates may be those of several feeds."""
    return codec.encoded({c: F.col(c) for c in ("type", "ts_ns", "ref", "new_ref", "side", "shares", "price", "state")} | codec.of_feed(F.col("locate")))


def _whole_locates(rows: DataFrame) -> DataFrame:
    return rows.withColumn("locate", codec.over_feeds(F.col("locate"), F.col("tracking")))


_WIRE = "type IN ('A', 'E', 'X', 'D', 'U', 'H') AND (ref IS NOT NULL OR type IN ('A', 'H'))"


@query(O.on_events(
    f"SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, 'Ok' AS status, {', '.join(_ROUND[1:]).replace('side', _WIRE_SIDE)} FROM m WHERE {_WIRE}"
))
@_on()
def framed_scan(s):
    """Messages written as framed binary files, scanned and decoded again."""
    rows = s.messages.where(_WIRE)
    path = f"{scratch.folder(rows.sparkSession)}/frames-{uuid.uuid4().hex}"
    framed.write_framed(rows.select("idx", _body().alias("body")), path)
    return _whole_locates(framed.decode(framed.in_order(framed.read_framed(rows.sparkSession, path)))).select("idx", "status", *_ROUND[1:])


_STATUS = """
SELECT status, kind AS type, count(*) AS n FROM (
  SELECT kind, CASE WHEN len = 0 THEN 'Empty' WHEN kind = 'z' THEN 'UnknownType' WHEN len < need THEN 'Truncated' WHEN kind = 'P' THEN 'Other' ELSE 'Ok' END AS status
  FROM (SELECT kind, need, CASE WHEN idx % 17 = 0 THEN 0 WHEN idx % 13 = 0 THEN need - 1 WHEN idx % 11 = 0 THEN need + 3 ELSE need END AS len FROM (
    SELECT idx, CASE WHEN idx % 19 = 0 THEN 'z' ELSE type END AS kind,
           CASE WHEN idx % 19 = 0 THEN 5 ELSE CASE type WHEN 'A' THEN 36 WHEN 'E' THEN 31 WHEN 'X' THEN 23 WHEN 'D' THEN 19 WHEN 'U' THEN 35 WHEN 'H' THEN 25 ELSE 44 END END AS need
    FROM m))) GROUP BY ALL"""


@query(O.on_events(_STATUS))
@_on()
def message_status(s):
    """Statuses by the length table, over lengths that are cut, emptied and stretched by index."""
    def every(n: int):
        return F.pmod("idx", F.lit(n)) == 0

    kind = F.when(every(19), "z").otherwise(F.col("type"))
    need = F.when(every(19), F.lit(5)).otherwise(codec._lookup(codec.LENGTHS, F.col("type")))
    rows = s.messages.select("idx", kind.alias("type"), need.alias("need"))
    length = F.when(every(17), 0).when(every(13), F.col("need") - 1).when(every(11), F.col("need") + 3).otherwise(F.col("need"))
    return rows.groupBy(codec.status_of(F.col("type"), length).alias("status"), "type").agg(F.count("*").alias("n"))


@query(O.on_events("SELECT (count(*) FILTER (WHERE ts_ns < prev))::BIGINT AS regressions FROM (SELECT ts_ns, lag(ts_ns) OVER (ORDER BY idx) AS prev FROM m)"))
@_on()
def ts_regressions(s):
    return workload.regressions(s.messages)


# -- lifecycle and book --------------------------------------------------------

_LIFE_COLUMNS = "ref, root, locate, side, price, qty0, born, born_ns, died, died_ns, end_kind"


@query(O.on_events(f"SELECT {_LIFE_COLUMNS} FROM life"))
@_on()
def order_life(s):
    return s.life.select(*_LIFE_COLUMNS.split(", "))


@query(O.on_orders(f"SELECT {_LIFE_COLUMNS} FROM life"))
@_on("orders")
def orders_lifecycle_tpch(s):
    return s.life.select(*_LIFE_COLUMNS.split(", "))


_DAY_COUNTS = ", ".join(
    [f"(count(*) FILTER (WHERE type IN {kinds}))::BIGINT AS {name}" for name, kinds in (
        ("adds", "('A', 'F')"), ("executes", "('E', 'C')"), ("cancels", "('X')"), ("deletes", "('D')"), ("replaces", "('U')"))]
    + [f"(count(*) FILTER (WHERE rejected = '{name}'))::BIGINT AS {name}" for name in ("unknown_ref", "duplicate_ref", "bad_locate", "zero_qty")]
    + ["(count(*) FILTER (WHERE over))::BIGINT AS overfill", "(count(*) FILTER (WHERE moved))::BIGINT AS locate_mismatch"]
)


@query(O.on_days(f"SELECT {_DAY_COUNTS} FROM walk JOIN m USING (idx)"))
@_on("daily")
def daily_counters(s):
    """The eleven counters of days whose references repeat, with every anomaly."""
    return s.counters()


@query(O.on_days("""
SELECT w.session, w.live[len(w.live)].ref AS ref, w.live[len(w.live)].root AS root, w.live[len(w.live)].locate AS locate, w.live[len(w.live)].side AS side,
       w.live[len(w.live)].price AS price, w.live[len(w.live)].qty0 AS qty0, w.idx AS born, d.idx AS died,
       CASE e.type WHEN 'E' THEN 'executed' WHEN 'C' THEN 'executed' WHEN 'X' THEN 'cancelled' WHEN 'D' THEN 'deleted' WHEN 'U' THEN 'replaced' END AS end_kind
FROM walk w LEFT JOIN walk d ON d.hit = w.idx AND d.gone LEFT JOIN m e ON e.idx = d.idx WHERE w.made"""))
@_on("daily")
def daily_life(s):
    return s.life.select("session", "ref", "root", "locate", "side", "price", "qty0", "born", "died", "end_kind")


@query(O.on_days("""
SELECT session, x.locate AS locate, x.side AS side, row_number() OVER (PARTITION BY session, x.locate, x.side ORDER BY CASE WHEN x.side = 'B' THEN -x.price ELSE x.price END) AS rank,
       x.price AS price, sum(x.qty)::BIGINT AS qty, count(*) AS orders
FROM (SELECT session, unnest(live) AS x FROM walk w WHERE k = (SELECT max(k) FROM line l WHERE l.session = w.session)) GROUP BY session, x.locate, x.side, x.price"""))
@_on("daily")
def daily_depth(s):
    """Resting depth at the end of every day."""
    return book.depth(s.remaining, scope=("session",))


@query("SELECT 0::BIGINT AS mismatches")
@_on("daily")
def daily_fold(s):
    """The joined lives of every day against books folded day by day: counters."""
    folded = fold.counters(fold.replay(s.messages, by=("session",), locates=s.locates))
    return diff.counter_mismatches(s.counters(), folded, ()).agg(F.count("*").alias("mismatches"))


_COUNTERS = """
SELECT count(*) FILTER (WHERE type = 'A') AS adds, count(*) FILTER (WHERE type = 'E') AS executes, count(*) FILTER (WHERE type = 'X') AS cancels,
       count(*) FILTER (WHERE type = 'D') AS deletes, count(*) FILTER (WHERE type = 'U') AS replaces,
       count(*) FILTER (WHERE type IN ('E', 'X', 'D', 'U')) - (SELECT count(*) FROM eff) AS unknown_ref, 0::BIGINT AS duplicate_ref,
       (SELECT count(*) FROM eff WHERE dies AND red > before) AS overfill, (SELECT count(*) FROM eff WHERE msg_locate <> locate) AS locate_mismatch,
       0::BIGINT AS bad_locate, 0::BIGINT AS zero_qty
FROM m"""


@query(O.on_events(_COUNTERS))
@_on()
def book_counters(s):
    return s.counters()


@query(O.on_events("SELECT locate, side, rank, price, qty, orders FROM dep"))
@_on()
def depth_final(s):
    return book.depth(s.remaining)


@query(O.on_events("SELECT locate, side, rank, price, qty, orders FROM dep WHERE rank <= 5"))
@_on()
def depth_top5(s):
    return book.depth(s.remaining, 5)


@query(O.on_events("SELECT locate, side, price, row_number() OVER (PARTITION BY locate, side, price ORDER BY born) AS place, ref, rem::BIGINT AS rem FROM rem"))
@_on()
def queue_fifo(s):
    return book.queue(s.remaining)


@query(O.on_events("SELECT ref, locate, side, price, rem::BIGINT AS rem FROM rem"))
@_on()
def find_orders(s):
    """Every reference that was ever created, looked up at the end."""
    return book.find(s.life, s.effects, s.messages.where("type IN ('A', 'U')").select(F.coalesce("new_ref", "ref").alias("ref")))


@query(O.on_events("SELECT idx, type, live FROM running"))
@_on()
def live_orders_running(s):
    return book.live_running(s.messages, s.life)


@query(O.on_events("SELECT max(live) AS peak FROM running WHERE type IN ('A', 'U')"))
@_on()
def peak_live(s):
    return book.live_running(s.messages, s.life).where(F.col("type").isin("A", "F", "U")).agg(F.max("live").alias("peak"))


@query(O.on_events("SELECT idx, locate, bid_px, bid_qty, ask_px, ask_qty FROM post", touch=True))
@_on("touch")
def top_of_book(s):
    return s.after.select("idx", "locate", *diff.TOP)


@query(O.on_events("SELECT idx, locate, bid_px, bid_qty, ask_px, ask_qty FROM pre"))
@_on()
def top_of_book_before(s):
    return s.before.select("idx", "locate", *diff.TOP)


# -- characterisation ----------------------------------------------------------


def _crossings(s: Stream) -> DataFrame:
    return workload.crossings(s.after, workload.trading_state(s.messages))


@query(O.on_events("SELECT idx, locate, type, state FROM stated"))
@_on()
def trading_state_asof(s):
    return workload.trading_state(s.messages).select("idx", "locate", "type", "state")


@query(O.on_events("SELECT count(*) AS checks, (count(*) FILTER (WHERE crossed))::BIGINT AS crossed, (count(*) FILTER (WHERE locked))::BIGINT AS locked FROM bucketed"))
@_on()
def crossed_locked(s):
    return _crossings(s).agg(F.count("*").alias("checks"), F.count_if("crossed").alias("crossed"), F.count_if("locked").alias("locked"))


@query(O.on_events("SELECT bucket, count(*) AS checks, count(*) FILTER (WHERE crossed) AS crossed, count(*) FILTER (WHERE locked) AS locked FROM bucketed GROUP BY bucket"))
@_on()
def invariant_buckets(s):
    return workload.invariant_buckets(_crossings(s))


@query(O.on_events("SELECT idx, ts_ns, locate, type, coalesce(state, '-') AS state, bid_px, bid_qty, ask_px, ask_qty FROM bucketed WHERE crossed OR locked ORDER BY idx LIMIT 100000"))
@_on()
def crossed_events(s):
    return workload.crossed_events(_crossings(s))


def _distances(s: Stream) -> DataFrame:
    return workload.distances(s.messages, s.effects, s.before)


@query(O.on_events(f"SELECT kind, way, {O.bucket('ticks')} AS bucket, count(*) AS n FROM dist WHERE ticks IS NOT NULL GROUP BY ALL", touch=True))
@_on("touch")
def distance_hist(s):
    return H.histogram(_distances(s).where("ticks IS NOT NULL"), F.col("ticks"), "kind", "way").select("kind", "way", "bucket", "n")


@query(O.on_events("SELECT kind, way, count(*) AS n FROM dist GROUP BY ALL"))
@_on()
def distance_ways(s):
    return _distances(s).groupBy("kind", "way").agg(F.count("*").alias("n"))


_WITHIN = ", ".join(map(str, workload.WITHIN))


@query(O.on_events(
    f"SELECT kind, w AS within, (sum(CASE WHEN {O.highest('b')} <= w THEN 1 ELSE 0 END))::BIGINT AS n, count(*) AS \"all\" "
    f"FROM (SELECT kind, {O.bucket('ticks')} AS b FROM dist WHERE ticks IS NOT NULL), (SELECT unnest([{_WITHIN}]) AS w) GROUP BY kind, w"
))
@_on()
def coverage(s):
    return workload.coverage(H.histogram(_distances(s).where("ticks IS NOT NULL"), F.col("ticks"), "kind"))


_ELAPSED = (
    "FROM (SELECT end_kind, d.session - l.session AS days, (d.session - l.session) * 86400000000000 + died_ns - born_ns AS lifetime "
    "FROM life l JOIN m d ON d.idx = l.died)"
)


def _elapsed(s: Stream) -> DataFrame:
    return H.histogram(workload.elapsed(s.messages, s.life), F.col("lifetime"), "end_kind")


# The bounds of the shares of short lives.
_BOUNDS = {"within_100us": 10**5, "within_1ms": 10**6, "within_1s": 10**9}


@query(O.on_events(f"SELECT end_kind, {O.bucket('lifetime')} AS bucket, count(*) AS n {_ELAPSED} GROUP BY ALL"))
@_on()
def lifetime_hist(s):
    """Lifetimes of all dead orders, over sessions."""
    return _elapsed(s).select("end_kind", "bucket", "n")


@query(O.on_events(
    "SELECT end_kind, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {O.highest('b')} <= {v}) AS {k}" for k, v in _BOUNDS.items())
    + f" FROM (SELECT end_kind, {O.bucket('lifetime')} AS b {_ELAPSED}) GROUP BY end_kind"
))
@_on()
def lifetime_shares(s):
    """Lifetimes in buckets that lie wholly within each bound."""
    hist = _elapsed(s)
    inside = [F.sum(F.when(H.highest_of(F.col("bucket")) <= v, F.col("n")).otherwise(0)).cast("long").alias(k) for k, v in _BOUNDS.items()]
    return hist.groupBy("end_kind").agg(F.sum("n").cast("long").alias("n"), *inside)


@query(O.on_events(
    O.quantiles(f"(SELECT end_kind, lifetime {_ELAPSED})", "lifetime", "end_kind", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999})
))
@_on()
def lifetime_quantiles(s):
    return H.quantiles(_elapsed(s), {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}, "end_kind")


@query(O.on_events(
    f"SELECT end_kind, days > 0 AS later, count(*) AS n {_ELAPSED} GROUP BY ALL UNION ALL SELECT 'live', NULL, count(*) FROM life WHERE died IS NULL HAVING count(*) > 0"
))
@_on()
def order_ends(s):
    """All orders: the dead by end, in their own or a later session, and the live."""
    dead = workload.elapsed(s.messages, s.life).groupBy("end_kind", (F.col("days") > 0).alias("later")).agg(F.count("*").alias("n"))
    live = s.life.where("died IS NULL").agg(F.count("*").alias("n")).where("n > 0")
    return dead.unionByName(live.select(F.lit("live").alias("end_kind"), F.lit(None).cast("boolean").alias("later"), "n"))


_WINDOWS = "SELECT session, (ts_ns - 34200000000000) // {w} AS win, count(*) AS n FROM m WHERE ts_ns >= 34200000000000 AND ts_ns < 57600000000000 GROUP BY ALL"


@query(O.on_events(_WINDOWS.format(w=10**9)))
@_on()
def rate_windows_1s(s):
    return workload.rate_windows(s.messages, 10**9)


def _zero_filled(width: int) -> str:
    total = (workload.CLOSE - workload.OPEN) // width
    return O.on_events(f"""
SELECT b AS bucket, sum(n)::BIGINT AS n FROM (
  SELECT {O.bucket('n')} AS b, count(*) AS n FROM win GROUP BY 1
  UNION ALL SELECT 0, sum(n) FROM (SELECT {total} - count(*) AS n FROM win GROUP BY session) HAVING sum(n) > 0) GROUP BY b""", more=f"win AS ({_WINDOWS.format(w=width)})")


def _rate(width: int) -> Callable[[Stream], DataFrame]:
    return lambda s: workload.rate_histogram(workload.rate_windows(s.messages, width), width)


for _name, _width in (("rate_hist_zero_filled", 10**9), ("rate_hist_10ms", 10**7), ("rate_hist_1ms", 10**6)):
    QUERIES[_name] = _on()(_rate(_width))
    SQL[_name] = _zero_filled(_width)


_BURST = O.on_events("SELECT max(n) AS peak, sum(n)::BIGINT AS messages, count(*) AS busy, max(n) / (sum(n)::BIGINT / (count(DISTINCT session) * 23400)) AS burst FROM win", more=f"win AS ({_WINDOWS.format(w=10**9)})")


@query(_BURST)
@_on()
def burst_table(s):
    """Peak against mean rate of regular hours, empty windows included."""
    rows = workload.rate_windows(s.messages, 10**9)
    mean = F.sum("n") / (F.count_distinct("session") * 23400)
    return rows.agg(F.max("n").alias("peak"), F.sum("n").alias("messages"), F.count("*").alias("busy"), (F.max("n") / mean).alias("burst"))


_SNAP = ["p50", "p90", "p99"]
_SNAPSHOTS = """
cuts AS (
  SELECT session, boundary_s, min(idx) AS cut FROM (SELECT DISTINCT session FROM m) JOIN (SELECT unnest(range(34200, 57601, 1800)) AS boundary_s) ON true
  JOIN m USING (session) WHERE ts_ns >= boundary_s * 1000000000 GROUP BY ALL
  UNION ALL SELECT arg_max(session, idx), 86400, max(idx) + 1 FROM m
), alive AS (SELECT c.session, boundary_s, locate, side, price FROM cuts c JOIN life l ON born < cut AND (died IS NULL OR died >= cut)),
lev AS (SELECT session, boundary_s, locate, side, price, count(*) AS orders FROM alive GROUP BY ALL),
sid AS (SELECT session, boundary_s, locate, side, count(*) AS levels FROM lev GROUP BY ALL)"""
_BY_SNAP = "session, boundary_s"


@query(O.on_events(f"""
SELECT a.session, a.boundary_s, a.live_orders, s.n AS sides, s.p50 AS levels_p50, s.p90 AS levels_p90, s.p99 AS levels_p99, s.max AS levels_max,
       o.p50 AS orders_p50, o.p99 AS orders_p99, o.max AS orders_max
FROM (SELECT session, boundary_s, count(*) AS live_orders FROM alive GROUP BY ALL) a
JOIN ({O.quantiles('sid', 'levels', _BY_SNAP, {'p50': 0.5, 'p90': 0.9, 'p99': 0.99}).replace('GROUP BY session, boundary_s, 2', 'GROUP BY session, boundary_s, b')}) s USING (session, boundary_s)
JOIN ({O.quantiles('lev', 'orders', _BY_SNAP, {'p50': 0.5, 'p99': 0.99}).replace('GROUP BY session, boundary_s, 2', 'GROUP BY session, boundary_s, b')}) o USING (session, boundary_s)""", more=_SNAPSHOTS))
@_on()
def depth_snapshots(s):
    return workload.depth_snapshots(s.messages, s.life)


_ACTIVITY = """
act AS (
  SELECT k.locate, n, coalesce(low, 0) AS low, coalesce(high, 0) AS high,
         (CASE WHEN low IS NULL OR low = 0 THEN 0 ELSE (high - low) // CASE WHEN low >= 10000 THEN 100 ELSE 1 END END)::BIGINT AS range_ticks
  FROM (SELECT locate, count(*) AS n FROM book GROUP BY locate) k
  LEFT JOIN (SELECT m.locate, min(l.price) AS low, max(l.price) AS high FROM m JOIN life l ON l.born = m.idx GROUP BY m.locate) p ON k.locate = p.locate
)"""


@query(O.on_events("SELECT * FROM act", more=_ACTIVITY))
@_on()
def symbol_activity(s):
    return workload.symbol_activity(s.messages, s.life)


@query(O.on_events("SELECT locate, low, high, range_ticks FROM act WHERE range_ticks > 0", more=_ACTIVITY))
@_on()
def range_ticks(s):
    return workload.symbol_activity(s.messages, s.life).where("range_ticks > 0").select("locate", "low", "high", "range_ticks")


@query(O.on_events(
    "SELECT quantile_cont(range_ticks, 0.5)::DOUBLE AS p50, quantile_cont(range_ticks, 0.9)::DOUBLE AS p90, quantile_cont(range_ticks, 0.99)::DOUBLE AS p99, max(range_ticks) AS top FROM act",
    more=_ACTIVITY,
))
@_on()
def range_percentiles(s):
    ranges = workload.symbol_activity(s.messages, s.life)
    return ranges.agg(*[F.percentile("range_ticks", F.lit(q)).alias(n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))], F.max("range_ticks").alias("top"))


@query(O.on_events(
    "SELECT top, (sum(n) FILTER (WHERE place <= top))::BIGINT AS n, sum(n)::BIGINT AS \"all\" FROM (SELECT n, row_number() OVER (ORDER BY n DESC, locate) AS place FROM act), "
    "(SELECT unnest([10::BIGINT, 100, 1000]) AS top) GROUP BY top",
    more=_ACTIVITY,
))
@_on()
def symbol_share(s):
    return workload.symbol_share(workload.symbol_activity(s.messages, s.life))


@query(O.on_events("SELECT locate, n FROM act ORDER BY n DESC, locate LIMIT 10", more=_ACTIVITY))
@_on()
def top_k_symbols(s):
    return workload.top_symbols(s.messages, 10)


@query(O.on_events("SELECT count(*) AS n, min(ref) AS low, max(ref) AS high, count(*) / (max(ref) - min(ref) + 1) AS density FROM life"))
@_on()
def ref_density(s):
    return workload.ref_density(s.life)


# -- slices, windows, schedules ------------------------------------------------

_ROW = "idx, type, locate, ref, new_ref, side, shares, price, state"


@query(O.on_events(f"SELECT {_ROW} FROM m WHERE locate IN (3, 5, 8) OR locate IN (SELECT locate FROM book GROUP BY locate ORDER BY count(*) DESC, locate LIMIT 4)"))
@_on()
def slice_symbols(s):
    return feed.by_symbols(s.messages, [3, 5, 8], 4).select(*_ROW.split(", "))


@query(O.on_events(f"SELECT {_ROW} FROM m WHERE idx < 1234"))
@_on()
def slice_first_n(s):
    return feed.first_n(s.messages, 1234).select(*_ROW.split(", "))


@query(O.on_events(f"SELECT {_ROW} FROM m WHERE locate = 8 AND idx <= 5000"))
@_on()
def slice_locate(s):
    return feed.by_locate(s.messages, 8, 5000).select(*_ROW.split(", "))


_FEED = f"""
feed AS (
  SELECT *, idx >= first AS measured FROM m, (SELECT min(idx) AS first FROM m WHERE ts_ns >= {FEED})
), span AS (SELECT arg_min(ts_ns, idx) AS a, arg_max(ts_ns, idx) AS b, count(*) AS n FROM feed WHERE measured)"""


@query(O.on_events(f"SELECT {_ROW}, measured FROM feed", more=_FEED))
@_on()
def feed_window(s):
    return feed.window(s.messages, FEED).select(*_ROW.split(", "), "measured")


@query(O.on_events(f"SELECT idx, round((idx - first) * {1e9 / RATE!r}::DOUBLE)::BIGINT AS offset_ns FROM feed WHERE measured", more=_FEED))
@_on()
def schedule_smooth(s):
    return feed.smooth(feed.window(s.messages, FEED), RATE)


@query(O.on_events(
    f"SELECT idx, (max(CASE WHEN ts_ns >= a THEN round((ts_ns - a) * ((n - 1) * {1e9 / RATE!r}::DOUBLE / (b - a)))::BIGINT ELSE 0 END) OVER (ORDER BY idx))::BIGINT AS offset_ns "
    "FROM feed, span WHERE measured",
    more=_FEED,
))
@_on()
def schedule_bursty(s):
    return feed.bursty(feed.window(s.messages, FEED), RATE)


# -- decisions -----------------------------------------------------------------


@query(O.on_events("SELECT idx, locate, action, price, qty FROM sig", touch=True))
@_on("touch")
def signals(s):
    return decide.signals(s.after)


_DECIDED = """
line AS (SELECT *, row_number() OVER (PARTITION BY locate ORDER BY idx) AS k FROM sig),
walk AS (
  SELECT locate, 0::BIGINT AS k, 0 AS pos, 0::BIGINT AS last, false AS made FROM (SELECT DISTINCT locate FROM sig)
  UNION ALL
  SELECT x.locate, x.k + 1, CASE WHEN ok THEN nxt ELSE x.pos END, CASE WHEN ok THEN num ELSE x.last END, ok FROM (
    SELECT w.*, s.idx + 1 AS num, w.pos + CASE WHEN s.action = 1 THEN 100 ELSE -100 END AS nxt,
           (w.last = 0 OR s.idx + 1 - w.last >= {cooldown}) AND abs(w.pos + CASE WHEN s.action = 1 THEN 100 ELSE -100 END) <= 1000 AS ok
    FROM walk w JOIN line s ON s.locate = w.locate AND s.k = w.k + 1) x
)"""
_TAKEN = "SELECT s.idx, s.locate, s.action, s.price, s.qty FROM walk w JOIN line s ON s.locate = w.locate AND s.k = w.k WHERE w.made"


@query(O.on_events(_TAKEN, touch=True, more=_DECIDED.format(cooldown=1000)))
@_on("touch")
def orders_decided(s):
    return decide.orders(decide.signals(s.after))


@query(O.on_events(_TAKEN, touch=True, more=_DECIDED.format(cooldown=QUIET)))
@_on("touch")
def orders_decided_quick(s):
    strategy = decide.Strategy(cooldown=QUIET)
    return decide.orders(decide.signals(s.after, strategy), strategy)


@query(O.on_events(f"""
SELECT lower(lpad(to_hex(list_reduce([14695981039346656037::HUGEINT] || list(byte ORDER BY idx, f, b), lambda x, y: (xor(x, y) * 1099511628211) % 18446744073709551616)::UBIGINT), 16, '0')) AS digest,
       count(DISTINCT idx) AS orders
FROM (SELECT idx, f, b, ((CASE f WHEN 0 THEN locate WHEN 1 THEN action WHEN 2 THEN price ELSE qty END >> (8 * b)) & 255)::HUGEINT AS byte
      FROM ({_TAKEN.replace('s.locate, s.action, s.price, s.qty', 's.locate::BIGINT AS locate, s.action::BIGINT AS action, s.price::BIGINT AS price, s.qty::BIGINT AS qty')}), (SELECT unnest(range(4)) AS f), (SELECT unnest(range(8)) AS b))""", touch=True, more=_DECIDED.format(cooldown=1000)))
def order_digest(spark, sf_dir):
    return decide.digest_row(orders_decided(spark, sf_dir))


@query(O.on_events("SELECT idx, locate, bid_px, bid_qty, ask_px, ask_qty FROM post", touch=True))
@_on("touch")
def streamed_tops(s):
    """The top of book from the streaming engine, in two micro-batches with kept state."""
    return book_stream.replayed(s.messages, locates=s.locates).select("idx", "locate", *diff.TOP)


@query(O.on_events(_TAKEN, touch=True, more=_DECIDED.format(cooldown=QUIET)))
@_on("touch")
def streamed_orders(s):
    rows = book_stream.replayed(s.messages, strategy=decide.Strategy(cooldown=QUIET), locates=s.locates).where("action IS NOT NULL")
    return rows.select("idx", "locate", "action", F.col("order_price").alias("price"), F.col("order_qty").alias("qty"))


# -- comparison ----------------------------------------------------------------


def _mutant(s: Stream) -> Stream:
    if "_mutant" not in s.__dict__:
        s.__dict__["_mutant"] = Stream(diff.drop_cancels(s.messages), s.scope, s.locates)
    return s.__dict__["_mutant"]


_PARTS = ", ".join(f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in diff.TOP)


@query(O.on_events(
    f"SELECT * FROM (SELECT coalesce(a.idx, b.idx) AS idx, a.locate, a.type, concat_ws(',', {_PARTS}) AS what FROM post a FULL JOIN post_2 b ON a.idx = b.idx) "
    "WHERE what <> '' ORDER BY idx LIMIT 1",
    more=O.twice("NOT (type = 'X' AND idx % 5 = 0)"),
))
@_on()
def book_diff(s):
    """Where a book that loses some cancels parts from the right one."""
    return diff.first_mismatch(s.after, _mutant(s).after)


@query("SELECT 0::BIGINT AS mismatches")
@_on()
def book_diff_fold(s):
    """The declarative book against the folded one: tops after every message, and counters."""
    folded = fold.replay(s.messages, locates=s.locates)
    tops = diff.top_mismatches(s.after, folded.select("idx", "locate", "type", *diff.TOP)).agg(F.count("*").alias("n"))
    counts = diff.counter_mismatches(s.counters(), fold.counters(folded)).agg(F.count("*").alias("n"))
    return tops.unionByName(counts).agg(F.sum("n").cast("long").alias("mismatches"))


_CUTS = """
numbered AS (SELECT idx, row_number() OVER (ORDER BY idx) AS k FROM book),
cuts AS (SELECT idx AS cut FROM numbered WHERE k % 2500 = 0 UNION SELECT max(idx) FROM numbered),
held AS (
  SELECT cut, l.locate, l.side, l.price, qty0 - coalesce((SELECT sum(red) FROM eff e WHERE e.ref = l.ref AND NOT dies AND e.idx <= cut), 0) AS rem
  FROM cuts JOIN life l ON born <= cut AND (died IS NULL OR died > cut)
)"""


@query(O.on_events(
    "SELECT cut, locate, side, row_number() OVER (PARTITION BY cut, locate, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS rank, price, "
    "sum(rem)::BIGINT AS qty, count(*) AS orders FROM held GROUP BY cut, locate, side, price", more=_CUTS,
))
@_on()
def depth_checkpoints(s):
    """Depths after every 2,500th book message and the last: what a full comparison reads."""
    return diff.checkpoint_depths(s.messages, s.life, s.effects, FULL_EVERY)


FULL_EVERY = 2500


def _checkpoints(second: str, mutation: str) -> str:
    """Depths at checkpoints of a second chain of tables, whose names end in ``_2``."""
    own = _CUTS[_CUTS.index("held AS"):].replace("held", "held_2").replace(" life ", " life_2 ").replace(" eff ", " eff_2 ")
    levels = lambda end: (
        f"dep_at{end} AS (SELECT cut, locate, side, row_number() OVER (PARTITION BY cut, locate, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS rank, price, "
        f"sum(rem)::BIGINT AS qty, count(*) AS orders FROM held{end} GROUP BY cut, locate, side, price)"
    )
    return f"{O.twice(mutation)}, {_CUTS}, {own}, {levels('')}, {levels('_2')}{second}"


_FAULT = "NOT (type = 'X' AND idx % 5 = 0)"
_DEPTHS_DIFFER = (
    "SELECT cut, locate, side, rank, a.price AS a_price, a.qty AS a_qty, a.orders AS a_orders, b.price AS b_price, b.qty AS b_qty, b.orders AS b_orders "
    "FROM dep_at a FULL JOIN dep_at_2 b USING (cut, locate, side, rank) WHERE a.price IS DISTINCT FROM b.price OR a.qty IS DISTINCT FROM b.qty OR a.orders IS DISTINCT FROM b.orders"
)


def _depths_differ(s: Stream, first: bool = False) -> DataFrame:
    return diff.checkpoint_mismatches(s.messages, [(x.life, x.effects) for x in (s, _mutant(s))], FULL_EVERY, first)


@query(O.on_events(_DEPTHS_DIFFER, more=_checkpoints("", _FAULT)))
@_on()
def depth_diff(s):
    """Levels at checkpoints in which a book that loses some cancels differs from the right one."""
    names = ["price", "qty", "orders"]
    return _depths_differ(s).select("cut", "locate", "side", "rank", *[f"{x}_{c}" for x in "ab" for c in names])


@query(O.on_events(
    f"""SELECT (SELECT count(*) FROM m) AS messages, (SELECT count(*) FROM book) AS top_checks, {FULL_EVERY}::BIGINT AS full_every, ((SELECT count(*) FROM book) + {FULL_EVERY - 1}) // {FULL_EVERY} AS full_checks,
  c.*, (SELECT count(*) FROM rem) AS live_end, p.idx AS mismatch_idx, p.locate AS mismatch_locate, p.type AS mismatch_type, p.what AS mismatch_what, p.idx IS NULL AS agree
FROM ({_COUNTERS}) c LEFT JOIN first p ON true""",
    more=_checkpoints(f""", differ AS ({_DEPTHS_DIFFER}), first AS (
  SELECT * FROM (
    SELECT 0 AS late, coalesce(a.idx, b.idx) AS idx, a.locate, a.type, concat_ws(',', {_PARTS}) AS what FROM post a FULL JOIN post_2 b ON a.idx = b.idx
    UNION ALL SELECT 1, cut, d.locate, m.type, CASE WHEN min(d.side) = 'B' THEN 'bid depth' ELSE 'ask depth' END FROM differ d JOIN m ON m.idx = d.cut GROUP BY cut, d.locate, m.type
  ) WHERE what <> '' ORDER BY idx, late, locate LIMIT 1)""", _FAULT),
))
@_on()
def diff_record(s):
    """The record of a comparison: checks made, agreement, counters and the first mismatch."""
    live = s.remaining.agg(F.count("*").alias("live_end"))
    return diff.agreement(s.messages, s.after, _mutant(s).after, _depths_differ(s, first=True), s.counters(), live, FULL_EVERY)


@query(O.on_events("SELECT count(*) AS levels, 0::BIGINT AS empty_level, 0::BIGINT AS unsorted FROM dep"))
@_on()
def depth_invariants(s):
    return diff.depth_invariants(book.depth(s.remaining))


@query(O.on_events("SELECT locate, arg_max(state, idx) AS state FROM m WHERE type = 'H' GROUP BY locate"))
@_on()
def last_states(s):
    rows = s.messages.withColumns({"stock": F.lit(None).cast("string"), "round_lot": F.lit(None).cast("long")})
    return directory.directory(rows).select("locate", "state")


@query(O.on_events(
    "SELECT CASE WHEN type = 'A' THEN 'add' WHEN type = 'E' THEN 'execute' WHEN type = 'X' THEN 'cancel' WHEN type = 'D' THEN 'delete' WHEN type = 'U' THEN 'replace' ELSE 'none' END AS kind, count(*) AS n FROM m GROUP BY 1"
))
@_on()
def event_kinds(s):
    return directory.event_kinds(s.messages).groupBy("kind").agg(F.count("*").alias("n"))


@query(O.on_events("SELECT idx // 1024 AS block, min(idx) AS first, max(idx) AS last, count(*) AS n, max(ts_ns) - min(ts_ns) AS span_ns FROM m GROUP BY 1"))
@_on()
def blocks_1024(s):
    return directory.blocks(s.messages)


@query(O.on_events(
    "SELECT (SELECT count(*) FROM m) AS messages, (SELECT count(*) FROM book) AS book_messages, (SELECT count(*) FROM life) AS orders, (SELECT count(*) FROM rem) AS live_end, "
    "(SELECT max(live) FROM running WHERE type IN ('A', 'U')) AS peak_live, (SELECT count(*) FROM bucketed WHERE crossed) AS crossed, (SELECT count(*) FROM dist WHERE way = 'no_best') AS no_best_on_side"
))
@_on()
def summary(s):
    """The scalars of a characterisation, as one row (``sinks.write_json`` writes it)."""
    parts = [
        directory.book_share(s.messages).select(F.col("n").alias("messages"), F.col("book").alias("book_messages")),
        s.life.agg(F.count("*").alias("orders"), F.count_if(F.col("died").isNull()).alias("live_end")),
        book.live_running(s.messages, s.life).where(F.col("type").isin("A", "F", "U")).agg(F.max("live").alias("peak_live")),
        _crossings(s).agg(F.count_if("crossed").alias("crossed")),
        _distances(s).agg(F.count_if(F.col("way") == "no_best").alias("no_best_on_side")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


# -- measurements --------------------------------------------------------------


def _runs(spark, sf_dir):
    return views.runs(spark, sf_dir)


@query(O.on_runs(f"SELECT variant, run, {O.bucket('sample')} AS bucket, count(*) AS n, sum(sample)::BIGINT AS total, min(sample) AS least, max(sample) AS most FROM runs GROUP BY 1, 2, 3"))
def hist_buckets(spark, sf_dir):
    return H.histogram(_runs(spark, sf_dir), F.col("sample"), "variant", "run").withColumn("total", F.col("total").cast("long"))


@query(O.on_runs(f"SELECT variant, bucket, {O.lowest('bucket')} AS low, least({O.highest('bucket')}, top) AS high, n FROM (SELECT variant, {O.bucket('sample')} AS bucket, count(*) AS n FROM runs GROUP BY 1, 2) JOIN (SELECT variant, max(sample) AS top FROM runs GROUP BY 1) USING (variant)"))
def hist_csv(spark, sf_dir):
    """Rows of a written histogram: bounds (the upper one clamped to the largest value) and count."""
    hist = H.histogram(_runs(spark, sf_dir), F.col("sample"), "variant")
    top = F.max("most").over(Window.partitionBy("variant"))
    return hist.select("variant", "bucket", H.lowest_of(F.col("bucket")).alias("low"), F.least(H.highest_of(F.col("bucket")), top).alias("high"), "n")


_Q = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


@query(O.on_runs(O.quantiles("runs", "sample", "variant, run", _Q).replace("GROUP BY variant, run, 2", "GROUP BY variant, run, b")))
def hist_quantiles(spark, sf_dir):
    return H.quantiles(H.histogram(_runs(spark, sf_dir), F.col("sample"), "variant", "run"), _Q, "variant", "run")


@query(O.on_runs(O.quantiles("runs", "sample", "variant", _Q)))
def hist_merge(spark, sf_dir):
    """Quantiles of the merged runs of a variant."""
    return H.quantiles(H.merge(H.histogram(_runs(spark, sf_dir), F.col("sample"), "variant", "run"), "variant"), _Q, "variant")


_PER_RUN = f"q AS ({O.quantiles('runs', 'sample', 'variant, run', _Q).replace('GROUP BY variant, run, 2', 'GROUP BY variant, run, b')})"


@query(O.on_runs(
    "SELECT variant, count(*) AS runs, median(p50)::DOUBLE AS p50, median(p90)::DOUBLE AS p90, median(CASE WHEN n >= 10000 THEN p99 END)::DOUBLE AS p99, median(max)::DOUBLE AS max, median(mean) AS mean FROM q GROUP BY variant",
    more=_PER_RUN,
))
def run_medians(spark, sf_dir):
    return stats.medians(stats.run_quantiles(_runs(spark, sf_dir), "variant", "run"), "variant")


_COUNTED = {
    "cycles": "sum(sample)", "instructions": "sum(sample + run)", "branch_misses": "sum(run)", "cache_misses": "sum(run * 2)", "l1_misses": "sum(sample // 100)",
    "tlb_misses": "sum(run // 2)", "page_faults": "min(run)", "context_switches": "max(run)", "time_running_ns": "sum(sample) // 2", "time_enabled_ns": "sum(sample) // 2 + 7", "ops": "count(*)",
}
_MISSES = ("branch_misses", "cache_misses", "l1_misses", "tlb_misses", "page_faults", "context_switches")


@query(O.on_runs(
    f"SELECT *, cycles / ops AS cycles_per_op, instructions / ops AS instr_per_op, instructions / cycles AS ipc, cycles / time_running_ns AS ghz, 100.0::DOUBLE * time_running_ns / time_enabled_ns AS running_pct, "
    f"{', '.join(f'{c} / ops AS {c}_per_op' for c in _MISSES)} FROM (SELECT variant, {', '.join(f'({v})::BIGINT AS {k}' for k, v in _COUNTED.items())} FROM runs GROUP BY variant)"
))
def per_op_counters(spark, sf_dir):
    """Hardware counters per operation, from stand-ins for their counts."""
    counted = _runs(spark, sf_dir).groupBy("variant").agg(*[F.expr(v.replace("//", "div")).cast("long").alias(k) for k, v in _COUNTED.items()])
    return stats.per_operation(counted, F.col("ops"))


def _per_run(spark, sf_dir):
    return stats.run_quantiles(_runs(spark, sf_dir), "variant", "run")


@query()
def bootstrap_ci(spark, sf_dir):
    """Medians over runs with intervals; tests hold it against the plain resampling."""
    return stats.intervals(_per_run(spark, sf_dir), "variant", metrics=("p50",))


@query()
def ratio_ci(spark, sf_dir):
    return stats.against(_per_run(spark, sf_dir), "variant", "p50", "AF")


@query(O.on_runs(
    "SELECT NULL::DOUBLE AS p, u, (u - n1 * n2 / 2) / sqrt(n1::DOUBLE * n2 * (n1 + n2 + 1) / 12) AS z FROM (SELECT sum(r) FILTER (WHERE variant = 'AF') - count(*) FILTER (WHERE variant = 'AF') * (count(*) FILTER (WHERE variant = 'AF') + 1) / 2 AS u, "
    "count(*) FILTER (WHERE variant = 'AF') AS n1, count(*) FILTER (WHERE variant = 'RF') AS n2 FROM (SELECT variant, rank() OVER (ORDER BY sample) + (count(*) OVER (PARTITION BY sample) - 1) / 2 AS r FROM runs WHERE variant IN ('AF', 'RF')))"
))
def mann_whitney(spark, sf_dir):
    return stats.mann_whitney(_runs(spark, sf_dir), "variant", "AF", "RF")


_PAIRS = """
pairs AS (
  SELECT cpu_a, cpu_b, run, max(n) AS n, min(rtt)::BIGINT AS min_rtt, (max(rtt) FILTER (WHERE place = n // 2 + 1))::BIGINT AS p50_rtt,
         (max(rtt) FILTER (WHERE place = n * 99 // 100 + 1))::BIGINT AS p99_rtt, max(off) FILTER (WHERE place = 1) AS offset_at_min_rtt,
         max(off) FILTER (WHERE by_off = best // 2) AS offset_median_best, max(rtt) FILTER (WHERE place = best) / 2 AS bound_best,
         (count(*) FILTER (WHERE tb < t0 OR t3 < tb))::BIGINT AS violations FROM (
    SELECT *, CASE WHEN place <= best THEN row_number() OVER (PARTITION BY cpu_a, cpu_b, run, place <= best ORDER BY off, rtt) - 1 END AS by_off FROM (
      SELECT *, row_number() OVER (PARTITION BY cpu_a, cpu_b, run ORDER BY rtt, off) AS place, count(*) OVER (PARTITION BY cpu_a, cpu_b, run) AS n,
             greatest(1, count(*) OVER (PARTITION BY cpu_a, cpu_b, run) // 100) AS best
      FROM (SELECT *, t3 - t0 AS rtt, tb - t0 - (t3 - t0) / 2 AS off FROM pings))) GROUP BY cpu_a, cpu_b, run
)"""


@query(O.on_runs("SELECT * FROM pairs", more=_PAIRS))
def ping_pairs(spark, sf_dir):
    return stats.ping_pairs(views.pings(spark, sf_dir))


@query(O.on_runs(
    "SELECT x.cpu_a, x.cpu_b, CASE WHEN x.cpu_b - x.cpu_a = 4 THEN 'sibling' ELSE 'core' END AS relation, count(*) AS runs, "
    "median((x.offset_median_best - y.offset_median_best) / 2) AS skew, median((x.offset_median_best + y.offset_median_best) / 2) AS asymmetry, "
    "median(greatest(x.bound_best, y.bound_best)) AS bound, median((x.p50_rtt + y.p50_rtt) / 4) AS half_rtt, sum(x.violations + y.violations)::BIGINT AS violations "
    "FROM pairs x JOIN pairs y ON x.cpu_a = y.cpu_b AND x.cpu_b = y.cpu_a AND x.run = y.run WHERE x.cpu_a < x.cpu_b GROUP BY x.cpu_a, x.cpu_b",
    more=_PAIRS,
))
def skew_pairs(spark, sf_dir):
    return stats.skew(stats.ping_pairs(views.pings(spark, sf_dir)))


@query()
def skew_intervals(spark, sf_dir):
    """Intervals of the skew of every pair; tests hold it against the plain resampling."""
    return stats.intervals(stats.skew_runs(stats.ping_pairs(views.pings(spark, sf_dir))), "cpu_a", "cpu_b", "relation", metrics=("skew",))


def _capacity(spark, sf_dir):
    rate = _runs(spark, sf_dir).groupBy("variant", "run").agg((F.lit(1e3) * F.count("*") / F.sum("sample")).alias("rate"))
    return rate.select(F.substring("variant", 1, 1).alias("work"), F.when(F.substring("variant", 2, 1) == "F", "a").otherwise("b").alias("model"), "run", "rate")


_CAPACITY = "cap AS (SELECT variant[1] AS work, CASE WHEN variant[2] = 'F' THEN 'a' ELSE 'b' END AS model, run, 1e3::DOUBLE * count(*) / sum(sample)::BIGINT AS rate FROM runs GROUP BY variant, run)"


@query(O.on_runs(
    "SELECT work, median(rate) FILTER (WHERE model = 'a') AS a, median(rate) FILTER (WHERE model = 'b') AS b, median(rate) FILTER (WHERE model = 'b') / median(rate) FILTER (WHERE model = 'a') AS b_over_a FROM cap GROUP BY work",
    more=_CAPACITY,
))
def capacity_table(spark, sf_dir):
    """Median rates of both models by work, and their ratio."""
    met = _capacity(spark, sf_dir).groupBy("work").agg(*[F.median(F.when(F.col("model") == m, F.col("rate"))).alias(m) for m in "ab"])
    return met.withColumn("b_over_a", F.col("b") / F.col("a"))


@query()
def capacity_intervals(spark, sf_dir):
    """Median rates of both models by work, with intervals."""
    return stats.intervals(_capacity(spark, sf_dir), "work", "model", metrics=("rate",))


@query()
def capacity_ratios(spark, sf_dir):
    """The ratio and difference of model b's rate to a's by work, with intervals."""
    return stats.against(_capacity(spark, sf_dir), "model", "rate", "a", "work")


def _sweep(spark, sf_dir):
    return _per_run(spark, sf_dir).withColumns({"arrival": F.when(F.pmod("run", F.lit(2)) == 0, "smooth").otherwise("bursty"), "rate": F.floor(F.col("run") / 4)})


@query()
def sweep_intervals(spark, sf_dir):
    """Median latencies by variant, arrival and rate, with intervals."""
    return stats.intervals(_sweep(spark, sf_dir), "variant", "arrival", "rate", metrics=("p50", "p99", "p999", "max"))


@query(O.on_runs(
    "SELECT variant, arrival, rate, count(*) AS runs, median(p50)::DOUBLE AS p50, median(p90)::DOUBLE AS p90, median(max)::DOUBLE AS max FROM (SELECT *, CASE WHEN run % 2 = 0 THEN 'smooth' ELSE 'bursty' END AS arrival, run // 4 AS rate FROM q) GROUP BY ALL",
    more=_PER_RUN,
))
def sweep_table(spark, sf_dir):
    """Median latencies by variant, arrival and rate."""
    return stats.medians(_sweep(spark, sf_dir), "variant", "arrival", "rate", metrics=("p50", "p90", "max"))


@query(O.on_runs(
    "SELECT variant AS \"window\", count(DISTINCT digest) AS digests, count(DISTINCT orders) AS orders, count(DISTINCT digest) = 1 AND count(DISTINCT orders) = 1 AS agree "
    "FROM (SELECT variant, run, max(sample)::VARCHAR AS digest, count(*) AS orders FROM runs GROUP BY variant, run) GROUP BY variant"
))
def digest_check(spark, sf_dir):
    """Runs of a window with as many orders and the same digest agree."""
    rows = _runs(spark, sf_dir).groupBy(F.col("variant").alias("window"), "run").agg(F.max("sample").cast("string").alias("digest"), F.count("*").alias("orders"))
    return stats.digests_agree(rows)


# -- wire formats, directory, files ----------------------------------------------

# Messages of every decoded type, made from events: the type goes by the index.
_KINDS = "AFECXDURSH"
_MADE = {
    "locate": ("int", "idx % 9 + 1"), "tracking": ("int", "idx % 300"), "ts_ns": ("long", "idx * 1000 + 7"), "ref": ("long", "idx * 12345678901 + 5"), "new_ref": ("long", "idx * 3 + 1"),
    "side": ("string", "CASE WHEN idx % 3 = 0 THEN 'B' ELSE 'S' END"), "shares": ("long", "idx % 1000 + 1"), "price": ("long", "idx % 90000 * 100 + 1"),
    "stock": ("string", "concat('SY', idx % 9 + 1)"), "mpid": ("string", "concat('M', idx % 100)"), "match_no": ("long", "idx * 7"), "printable": ("boolean", "idx % 4 <> 0"),
    "exec_price": ("long", "idx % 777 + 2"), "market_category": ("string", "CASE WHEN idx % 20 < 10 THEN 'Q' ELSE 'N' END"), "financial_status": ("string", "'N'"),
    "round_lot": ("long", "CASE WHEN idx % 20 < 10 THEN 100 ELSE 10 END"), "round_lots_only": ("string", "'Y'"), "event_code": ("string", "CASE WHEN idx % 20 < 10 THEN 'O' ELSE 'Q' END"),
    "state": ("string", "CASE WHEN idx % 20 < 10 THEN 'T' ELSE 'H' END"), "reason": ("string", "'NEWS'"),
}
_HEAD = ("locate", "tracking", "ts_ns")


def _has(name: str) -> str:
    """The types that carry a field, as an SQL list."""
    kinds = _KINDS if name in _HEAD else [k for k in _KINDS if any(f[0] == name for f in codec.FIELDS[k]) or (name == "shares" and k == "D")]
    return ", ".join(f"'{k}'" for k in kinds)


def _made(own: str) -> str:
    columns = ", ".join(f"CASE WHEN type IN ({_has(n)}) THEN {'CASE WHEN type = ' + repr('D') + f' THEN 0 ELSE {v} END' if n == 'shares' else v} END AS {n}" for n, (_, v) in _MADE.items())
    return f"made AS (SELECT idx, type, {columns}, CASE WHEN type IN ('A', 'F') THEN type = 'F' END AS attributed FROM (SELECT event_id AS idx, substr('{_KINDS}', (event_id % 10 + 1)::INT, 1) AS type FROM events))\n{own}"


def _every_type(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("idx"))
    rows = rows.withColumn("type", F.expr(f"substr('{_KINDS}', cast(idx % 10 + 1 AS int), 1)"))
    return rows.select("idx", "type", *[F.expr(v).cast(kind).alias(n) for n, (kind, v) in _MADE.items()])


def _bodies(spark, sf_dir) -> DataFrame:
    rows = _every_type(spark, sf_dir)
    return rows.select("idx", codec.encoded({c: F.col(c) for c in rows.columns if c != "idx"}).alias("body"))


def _read_back(spark, sf_dir, compression: str) -> DataFrame:
    """Messages of every type written as framed files, scanned and decoded again."""
    path = f"{scratch.folder(spark)}/frames-{uuid.uuid4().hex}"
    framed.write_framed(_bodies(spark, sf_dir), path, compression)
    return framed.decode(framed.in_order(framed.read_framed(spark, path)))


@query(f"WITH {_made('SELECT * FROM made')}")
def decode_all_types(spark, sf_dir):
    """Every field of every decoded type, through the wire format and back."""
    got = codec.decoded(F.col("body"))
    return _bodies(spark, sf_dir).select("idx", got["type"], *[got[c] for c in (*_MADE, "attributed")])


@query(f"WITH {_made('SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, type, locate, ts_ns, ref, shares, price, stock, event_code, state FROM made')}")
def framed_gzip(spark, sf_dir):
    """The same through compressed files."""
    return _read_back(spark, sf_dir, "gzip").select("idx", "type", "locate", "ts_ns", "ref", "shares", "price", "stock", "event_code", "state")


@query(f"WITH {_made('SELECT type, count(*) AS n, sum(locate)::BIGINT AS locates, sum(ts_ns)::BIGINT AS times FROM made GROUP BY type')}")
def header_of_undecoded(spark, sf_dir):
    """Types and headers of messages cut after the header, which are not decoded."""
    cut = _bodies(spark, sf_dir).select(F.expr("substring(body, 1, 11)").alias("body"))
    got = codec.decoded(F.col("body"))
    status = codec.status_of(codec.type_of(F.col("body")), F.length("body")).alias("status")
    rows = cut.select(status, got["type"], got["locate"], got["ts_ns"], got["ref"]).where("status = 'Truncated' AND ref IS NULL")
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.sum("locate").alias("locates"), F.sum("ts_ns").alias("times"))


@query("WITH " + _made("""SELECT locate, arg_max(stock, idx) FILTER (WHERE type = 'R') AS symbol, arg_max(round_lot, idx) FILTER (WHERE type = 'R') AS round_lot,
  arg_max(state, idx) FILTER (WHERE type = 'H') AS state, count(*) FILTER (WHERE type = 'R') > 0 AS known FROM made WHERE type IN ('R', 'H') GROUP BY locate"""))
def directory_entries(spark, sf_dir):
    """Names, round lots and states as the last messages have them."""
    return directory.directory(_every_type(spark, sf_dir))


@query("WITH " + _made("SELECT arg_max(event_code, idx) AS event_code FROM made WHERE type = 'S'"))
def last_system_event(spark, sf_dir):
    return directory.last_system_event(_every_type(spark, sf_dir))


@query("WITH " + _made("""SELECT b.locate, coalesce(symbol, '') AS symbol, n FROM (SELECT locate, count(*) AS n FROM made WHERE type IN ('A', 'F', 'E', 'C', 'X', 'D', 'U') GROUP BY locate) b
  LEFT JOIN (SELECT locate, arg_max(stock, idx) AS symbol FROM made WHERE type = 'R' GROUP BY locate) r ON b.locate = r.locate"""))
def symbols_by_locate(spark, sf_dir):
    """Book messages by locate, with the symbol (empty where unknown)."""
    rows = _every_type(spark, sf_dir)
    counted = rows.where(lifecycle.is_book()).groupBy("locate").agg(F.count("*").alias("n"))
    return directory.with_symbols(counted, directory.directory(rows)).select("locate", "symbol", "n")


@query("SELECT o_orderkey - 1 - missing AS after, missing FROM (SELECT o_orderkey, o_orderkey - lag(o_orderkey) OVER (ORDER BY o_orderkey) - 1 AS missing FROM orders WHERE o_orderkey % 7 <> 3) WHERE missing > 0")
def sequence_gaps(spark, sf_dir):
    """Holes in a sequence of numbers from which every seventh is missing."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 7 <> 3")
    return workload.gaps(rows.select(F.col("o_orderkey").alias("idx")))


_CLOCK = "lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0')"


@query(O.on_events(f"""SELECT idx, {_CLOCK} AS clock, s * 1000000000 AS clock_ns, 'locate=' || locate || '__kind=' || type AS variant, locate::VARCHAR AS field, CASE WHEN idx % 2 = 0 THEN 'permsg' ELSE 'batch' END AS method,
  (price // 10000) || '.' || lpad((price % 10000)::VARCHAR, 4, '0') AS price FROM (SELECT *, ts_ns // 1000000000 AS s FROM m)"""))
@_on()
def text_forms(s):
    """Clock times, run names and prices as text, and back."""
    second = F.floor(F.col("ts_ns") / 10**9)
    parts = [F.lpad(p.cast("string"), 2, "0") for p in (F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)]
    variant = text.variant_id(locate=F.col("locate"), kind=F.col("type"))
    file = F.concat(variant, F.when(F.col("idx") % 2 == 0, "_permsg").otherwise(""), F.lit(".hist.csv"))
    rows = s.messages.select("idx", F.concat_ws(":", *parts).alias("clock"), variant.alias("variant"), text.method_of(file).alias("method"), text.price_text(F.col("price")).alias("price"))
    return rows.select("idx", "clock", text.clock_ns(F.col("clock")).alias("clock_ns"), "variant", text.variant_fields(F.col("variant"))["locate"].alias("field"), "method", "price")


@query(O.on_runs(f"SELECT {O.lowest('b')} AS low, least({O.highest('b')}, top) AS high, n AS count FROM (SELECT {O.bucket('sample')} AS b, count(*) AS n FROM runs GROUP BY 1), (SELECT max(sample) AS top FROM runs)"))
def histogram_file(spark, sf_dir):
    """A histogram written as CSV and read again."""
    path = f"{scratch.folder(spark)}/hist-{uuid.uuid4().hex}/all/run01.hist.csv"
    sinks.write_histogram(H.histogram(_runs(spark, sf_dir), F.col("sample")), path)
    return sinks.read_histograms(spark, path).select("low", "high", "count")


@query(O.on_runs("SELECT variant, run, count(*) AS n, 'op\"s' AS unit, min(sample) / 2.0::DOUBLE AS least_ns, max(sample) / 2.0::DOUBLE AS most_ns FROM runs GROUP BY variant, run"))
def run_records(spark, sf_dir):
    """Metadata of runs written as JSON and read again, joined with the runs' histograms
    by name, which turns ticks into nanoseconds."""
    hist = H.histogram(_runs(spark, sf_dir), F.col("sample"), "variant", "run")
    meta = hist.groupBy("variant", "run").agg(F.sum("n").alias("n")).withColumns({"unit": F.lit('op"s'), "ticks_per_ns": F.lit(2.0)})
    path = f"{scratch.folder(spark)}/meta-{uuid.uuid4().hex}"
    sinks.write_metadata(meta, path)
    met = sinks.with_metadata(hist, sinks.read_metadata(spark, path), "variant", "run")
    ns = {c: stats.in_ns(F.col(c), F.col("ticks_per_ns")) for c in ("least", "most")}
    return met.groupBy("variant", "run").agg(F.max("meta_n").alias("n"), F.max("unit").alias("unit"), F.min(ns["least"]).alias("least_ns"), F.max(ns["most"]).alias("most_ns"))


@query(O.on_runs("""SELECT variant, count(*) AS threads, sum(cycles)::BIGINT AS cycles, min(running / enabled) AS worst_running FROM (
  SELECT variant, run, sum(sample) AS cycles, sum(sample)::BIGINT AS running, sum(sample)::BIGINT + run AS enabled FROM runs GROUP BY variant, run) GROUP BY variant"""))
def thread_counters(spark, sf_dir):
    """Counters summed over threads, and the worst share of time that one was counted."""
    one = _runs(spark, sf_dir).groupBy("variant", "run").agg(F.sum("sample").alias("cycles"))
    one = one.withColumns({"time_running_ns": F.col("cycles"), "time_enabled_ns": F.col("cycles") + F.col("run")})
    return stats.over_threads(one, "variant", counters=("cycles",))


@query(O.on_runs(f"""SELECT mode, variant, count(*) AS n, min(sample) AS least, max(sample) AS most FROM (SELECT *, CASE WHEN run % 3 = 0 THEN 'throughput' ELSE 'latency' END AS mode FROM runs)
  WHERE mode = 'latency' GROUP BY mode, variant"""))
def latency_runs(spark, sf_dir):
    """Runs of one mode of measurement."""
    rows = _runs(spark, sf_dir).withColumn("mode", F.when(F.pmod("run", F.lit(3)) == 0, "throughput").otherwise("latency"))
    return stats.of_mode(rows, "latency").groupBy("mode", "variant").agg(F.count("*").alias("n"), F.min("sample").alias("least"), F.max("sample").alias("most"))


_NAMED = {
    **{f"counter_{c}": f"(SELECT {c} FROM counted)" for c in ("adds", "executes", "cancels", "deletes", "replaces", "unknown_ref", "duplicate_ref", "overfill", "locate_mismatch", "bad_locate", "zero_qty")},
    "messages": "(SELECT count(*) FROM m)", "book_messages": "(SELECT count(*) FROM book)", "live_orders_end": "(SELECT count(*) FROM rem)",
    "peak_live_orders": "(SELECT max(live) FROM running WHERE type IN ('A', 'U'))", "timestamp_regressions": "(SELECT count(*) FROM (SELECT ts_ns, lag(ts_ns) OVER (ORDER BY idx) AS prev FROM m) WHERE ts_ns < prev)",
    "order_refs_count": "(SELECT count(*) FROM life)", "order_refs_min": "(SELECT min(ref) FROM life)", "order_refs_max": "(SELECT max(ref) FROM life)",
    "order_refs_density": "(SELECT count(*) / (max(ref) - min(ref) + 1) FROM life)", "no_best_on_side": "(SELECT count(*) FROM dist WHERE way = 'no_best')",
    **{f"invariant_{b}_{c}": f"(SELECT count(*) FROM bucketed WHERE bucket = {b}{'' if c == 'checks' else f' AND {c}'})" for b in range(3) for c in ("checks", "crossed", "locked")},
}
_SHARES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}


def _spread(name: str, source: str, value: str, keys: str) -> str:
    """Names and values of the quantiles of a table's groups."""
    found = f"({O.quantiles(source, value, keys, _SHARES)})"
    return " UNION ALL ".join(f"SELECT concat('{name}_', {keys}, '_{c}'), {c}::DOUBLE FROM {found}" for c in ("n", *_SHARES, "max"))


@query(O.on_events(
    " UNION ALL ".join(f"SELECT '{k}' AS name, {v}::DOUBLE AS value" for k, v in _NAMED.items())
    + " UNION ALL " + _spread("lifetime", f"(SELECT end_kind, lifetime {_ELAPSED})", "lifetime", "end_kind")
    + " UNION ALL " + _spread("distance_add", "(SELECT way, ticks FROM dist WHERE kind = 'add' AND ticks IS NOT NULL)", "ticks", "way"),
    more=f"counted AS ({_COUNTERS})",
))
@_on()
def summary_record(s):
    """All scalars of a characterisation, as names and values."""
    counted = s.counters()
    parts = [
        counted.select(*[F.col(c).alias(f"counter_{c}") for c in counted.columns]),
        directory.book_share(s.messages).select(F.col("n").alias("messages"), F.col("book").alias("book_messages")),
        s.remaining.agg(F.count("*").alias("live_orders_end")),
        book.live_running(s.messages, s.life).where(F.col("type").isin("A", "F", "U")).agg(F.max("live").alias("peak_live_orders")),
        workload.regressions(s.messages).withColumnRenamed("regressions", "timestamp_regressions"),
        workload.ref_density(s.life).select(F.col("n").alias("order_refs_count"), F.col("low").alias("order_refs_min"), F.col("high").alias("order_refs_max"), F.col("density").alias("order_refs_density")),
        _distances(s).agg(F.count_if(F.col("way") == "no_best").alias("no_best_on_side")),
        _crossings(s).agg(*[
            F.count_if((F.col("bucket") == b) & (F.lit(True) if c == "checks" else F.col(c))).alias(f"invariant_{b}_{c}") for b in range(3) for c in ("checks", "crossed", "locked")
        ]),
    ]

    def named(prefix: str, found: DataFrame, key: str) -> DataFrame:
        values = [F.struct(F.concat(F.lit(f"{prefix}_"), F.col(key), F.lit(f"_{c}")).alias("name"), F.col(c).cast("double").alias("value")) for c in ("n", *_SHARES, "max")]
        return found.select(F.inline(F.array(*values)))

    scalars = [p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in p.columns]))) for p in parts]
    adds = _distances(s).where("kind = 'add' AND ticks IS NOT NULL")
    scalars += [
        named("lifetime", H.quantiles(_elapsed(s), _SHARES, "end_kind"), "end_kind"),
        named("distance_add", H.quantiles(H.histogram(adds, F.col("ticks"), "way"), _SHARES, "way"), "way"),
    ]
    out = scalars[0]
    for part in scalars[1:]:
        out = out.unionByName(part)
    return out


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
