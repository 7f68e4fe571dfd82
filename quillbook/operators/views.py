"""Message tables derived from the Parquet tables of a data folder.

All have the columns ``idx, session, ts_ns, type, locate, ref, new_ref, side,
shares, price, state``.  ``idx`` is the total order of the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import scratch

COLUMNS = ["idx", "session", "ts_ns", "type", "locate", "ref", "new_ref", "side", "shares", "price", "state"]
_DAY_US = 86_400_000_000
#: Prices have four implied decimals; the touch view lies around this one.
TOUCH = 500_000


def _before(value: Column, over: Window) -> Column:
    return F.max(value).over(over.rowsBetween(Window.unboundedPreceding, -1))


def events(spark: SparkSession, sf_dir: str, touch: bool = False) -> DataFrame:
    """Messages from ``events``: clicks add orders, views execute, purchases cancel,
    errors delete, signups replace; each refers to the latest order made at its
    locate.  Rows with k of 97 and more are trading actions, with 96 trades.  With
    ``touch`` prices stay near one price, so that books are tight and uncrossed."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = (
        F.when(k >= 97, "H").when(k == 96, "P").when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "E")
        .when(F.col("event_type") == "purchase", "X").when(F.col("event_type") == "error", "D").otherwise("U")
    )
    rows = raw.select(
        F.col("event_id").alias("idx"), F.to_date("ts").alias("session"), (F.pmod(micros, F.lit(_DAY_US)) * 1000).alias("ts_ns"),
        kind.alias("type"), F.col("user_id").cast("int").alias("locate"), "value",
    )
    at = Window.partitionBy("locate").orderBy("idx")
    idx = F.col("idx")
    made = _before(F.when(F.col("type").isin("A", "U"), idx), at)
    # replacements refer to the order made before, so a chain starts at the last add
    root = _before(F.when(F.col("type") == "A", idx), at)
    own = F.when(F.pmod(idx, F.lit(2)) == 0, "B").otherwise("S")
    rows = rows.withColumns({
        "made": made,
        "side": F.when((F.col("type") == "U") & root.isNotNull() & F.lit(touch), F.when(F.pmod(root, F.lit(2)) == 0, "B").otherwise("S")).otherwise(own),
    })
    away = 100 * (1 + F.pmod(F.floor("value"), F.lit(2)))
    price = F.when(F.col("side") == "B", TOUCH - away).otherwise(TOUCH + away) if touch else F.round(F.col("value") * 100).cast("long") * 100
    book = F.col("type").isin("A", "E", "X", "D", "U")
    creates = F.col("type").isin("A", "U")
    shares = F.when(creates, 100 + 10 * F.pmod(idx, F.lit(7))).when(F.col("type").isin("E", "X"), 30 + 20 * F.pmod(idx, F.lit(5))).otherwise(0)
    state = F.element_at(F.array(*map(F.lit, "THPQ")), (F.pmod(idx, F.lit(4)) + 1).cast("int"))
    return rows.select(
        "idx", "session", "ts_ns", "type", "locate",
        F.when(F.col("type") == "A", idx).when(book, F.col("made")).alias("ref"),
        F.when(F.col("type") == "U", idx).alias("new_ref"),
        F.when(creates, F.col("side")).alias("side"),
        F.when(book, shares.cast("long")).alias("shares"),
        F.when(creates, price.cast("long")).alias("price"),
        F.when(F.col("type") == "H", state).alias("state"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of ``events`` as days with references of their own, of which many are used
    again on other days and some on the same day, and with every anomaly a book counts."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    idx, micros = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.pmod(idx, F.lit(10))
    kind = F.when(k < 4, "A").when(k == 4, "F").when(k == 5, "E").when(k == 6, "X").when(k == 7, "D").when(k == 8, "U").otherwise("C")
    creates = k.isin(0, 1, 2, 3, 4, 8)
    # creations walk through the references, so most of a day's are new; the others name one made shortly before
    ref = F.when(creates & (k != 8), F.pmod(idx, F.lit(997))).otherwise(F.pmod(idx - 3 - F.pmod(F.floor(idx / 10), F.lit(4)), F.lit(997)))
    shares = F.when(F.pmod(idx, F.lit(29)) == 0, 0).otherwise(10 + F.pmod(idx, F.lit(13)) * 5)
    locate = F.when((F.pmod(idx, F.lit(53)) == 0), 70_000).otherwise(F.pmod(F.floor(idx / 20), F.lit(7)))
    return raw.select(
        idx.alias("idx"), F.to_date("ts").alias("session"), (F.pmod(micros, F.lit(_DAY_US)) * 1000).alias("ts_ns"), kind.alias("type"),
        locate.cast("int").alias("locate"), ref.cast("long").alias("ref"), F.when(k == 8, F.pmod(idx * 3, F.lit(997))).cast("long").alias("new_ref"),
        F.when(creates & (k != 8), F.when(F.pmod(idx, F.lit(2)) == 0, "B").otherwise("S")).alias("side"), shares.cast("long").alias("shares"),
        F.when(creates, 100 * (500 + F.pmod(idx, F.lit(9)))).cast("long").alias("price"), F.lit(None).cast("string").alias("state"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from ``orders`` (adds) and ``lineitem`` (reductions by return flag)."""
    placed = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(placed.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    zero = F.lit(0).cast("long")
    adds = placed.select(
        F.col("o_orderdate").alias("ts"), F.lit(0).alias("rank"), F.col("o_orderkey").alias("ref"), zero.alias("line"), zero.alias("part"), zero.alias("supp"),
        F.lit("A").alias("type"), F.pmod("o_custkey", F.lit(64)).cast("int").alias("locate"), F.lit(100).cast("long").alias("shares"),
        (F.round(F.col("o_totalprice") * 100).cast("long") * 100).alias("price"),
    )
    kind = F.when(F.col("l_returnflag") == "A", "E").when(F.col("l_returnflag") == "N", "X").otherwise("D")
    cuts = lines.select(
        F.col("l_shipdate").alias("ts"), F.lit(1).alias("rank"), F.col("l_orderkey").alias("ref"), F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), kind.alias("type"), F.pmod("o_custkey", F.lit(64)).cast("int").alias("locate"),
        F.col("l_quantity").cast("long").alias("shares"), F.lit(None).cast("long").alias("price"),
    )
    both = adds.unionByName(cuts)
    # the total order of a merged stream: numbered per day, then moved up by the days before
    day = F.to_date("ts")
    both = both.withColumn("session", day)
    before = both.groupBy("session").agg(F.count("*").alias("n")).withColumn(
        "base", F.sum("n").over(Window.orderBy("session").rowsBetween(Window.unboundedPreceding, -1))
    )
    within = Window.partitionBy("session").orderBy("ts", "rank", "ref", "line", "part", "supp")
    idx = F.coalesce("base", F.lit(0)) + F.row_number().over(within) - 1
    both = both.join(scratch.small_side(before.select("session", "base")), "session").withColumn("idx", idx)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return both.select(
        "idx", "session", (F.pmod(micros, F.lit(_DAY_US)) * 1000).alias("ts_ns"), "type", "locate", "ref", F.lit(None).cast("long").alias("new_ref"),
        F.when(F.col("type") == "A", F.when(F.pmod("ref", F.lit(2)) == 0, "B").otherwise("S")).alias("side"), "shares", "price",
        F.lit(None).cast("string").alias("state"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``variant, run, sample`` of repeated measurements, from ``lineitem``."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat("l_returnflag", "l_linestatus").alias("variant"), F.pmod("l_orderkey", F.lit(10)).alias("run"),
        F.round("l_extendedprice").cast("long").alias("sample"),
    )


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cpu_a, cpu_b, run, t0, tb, t3`` of clock exchanges, from ``lineitem``."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.pmod("l_suppkey", F.lit(8)).alias("cpu_a"), F.pmod("l_partkey", F.lit(8)).alias("cpu_b"), F.pmod("l_orderkey", F.lit(10)).alias("run"),
        F.lit(0).cast("long").alias("t0"), (F.col("l_quantity") * 10).cast("long").alias("tb"),
        (1000 + F.round(F.pmod(F.round("l_extendedprice"), F.lit(500.0)))).cast("long").alias("t3"),
    )
