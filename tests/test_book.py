from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillbook.operators import book, decide, diff, feed, fold, lifecycle, workload
from quillbook.plans.session import Stream
from quillbook.sources.fixture import MODES, SCHEMA, Fixture, stream

CLEAN = [m for m in MODES if m not in ("error-paths", "mixed")]  # mixed has a part with errors


def made(spark, mode, messages=3000, seed=1):
    return Stream(stream(spark, Fixture(mode, seed, messages, 8)))


def messages(spark, rows):
    """``(type, locate, ref, new_ref, side, shares, price)`` in order."""
    full = [(i, None, i * 10, *r, None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA.replace("session date", "session date"))


def naive(rows):
    """Tops after every message, from flat lists."""
    live, out = {}, []
    for r in rows:
        if r.type in "AF" and r.shares > 0 and r.ref not in live:
            live[r.ref] = [r.locate, r.side, r.price, r.shares]
        elif r.type in "ECX" and r.ref in live:
            live[r.ref][3] -= r.shares
            if live[r.ref][3] <= 0:
                del live[r.ref]
        elif r.type == "D":
            live.pop(r.ref, None)
        elif r.type == "U" and r.ref in live:
            locate, side, *_ = live.pop(r.ref)
            if r.shares > 0 and r.new_ref not in live:
                live[r.new_ref] = [locate, side, r.price, r.shares]
        if r.type in "AFECXDU":
            level = defaultdict(int)
            for locate, side, price, qty in live.values():
                if locate == r.locate:
                    level[side, price] += qty
            bid = max((p for s, p in level if s == "B"), default=0)
            ask = min((p for s, p in level if s == "S"), default=0)
            out.append((r.idx, bid, level.get(("B", bid), 0), ask, level.get(("S", ask), 0)))
    return out


@pytest.mark.parametrize("mode", CLEAN)
def test_three_books_agree(spark, mode):
    s = made(spark, mode, 1500)
    assert lifecycle.duplicate_refs(s.messages).count() == 0
    want = naive(s.messages.orderBy("idx").collect())
    assert [tuple(r) for r in s.after.orderBy("idx").select("idx", *diff.TOP).collect()] == want
    folded = fold.replay(s.messages)
    assert diff.top_mismatches(s.after, folded).count() == 0
    a, b = lifecycle.counters(s.messages, s.life, s.effects), fold.counters(folded)
    assert a.first().asDict() == b.first().asDict()
    clean = a.first().asDict()
    assert all(clean[c] == 0 for c in ("unknown_ref", "duplicate_ref", "overfill", "locate_mismatch", "bad_locate", "zero_qty"))


@pytest.mark.parametrize("mode", ["realistic", "crossing", "replace-chains"])
def test_stretches(spark, monkeypatch, mode):
    """Tops and states do not depend on where the stream is cut."""
    monkeypatch.setattr(book, "CELL", 64)
    monkeypatch.setattr(book, "STRETCH", 100)
    s = made(spark, mode, 1500)
    assert book.stretches(s.messages, ["locate"]).agg(F.max("stretch")).first()[0] > 2
    want = naive(s.messages.orderBy("idx").collect())
    assert [tuple(r) for r in s.after.orderBy("idx").select("idx", *diff.TOP).collect()] == want
    whole = s.messages.select("idx", "locate", F.when(F.col("idx") % 7 == 0, F.col("idx").cast("string")).alias("state"))
    last, states = {}, {}
    for r in whole.orderBy("idx").collect():
        last[r.locate] = r.state or last.get(r.locate)
        states[r.idx] = last[r.locate]
    assert {r.idx: r.state for r in book.carried(whole, "locate", "idx", "state", cell=50).collect()} == states


def test_conservation(spark):
    s = made(spark, "replace-chains", 4000)
    n = lifecycle.counters(s.messages, s.life, s.effects).first()
    assert s.life.count() == n.adds + n.replaces
    assert s.life.where("died IS NOT NULL").count() + s.remaining.count() == s.life.count()
    assert s.after.count() == n.adds + n.executes + n.cancels + n.deletes + n.replaces
    assert s.before.count() == s.after.count()
    longest = s.life.groupBy("root").count().agg(F.max("count")).first()[0]
    assert longest > 30


def test_errors_are_counted(spark):
    s = made(spark, "error-paths", 6000)
    n = fold.counters(fold.replay(s.messages, by=())).first()
    assert min(n.unknown_ref, n.duplicate_ref, n.overfill, n.zero_qty, n.locate_mismatch) > 0


def test_fixtures(spark):
    one, two = (stream(spark, Fixture("realistic", 3, 500, 4)).orderBy("idx").collect() for _ in range(2))
    assert one == two and [r.idx for r in one] == list(range(len(one)))
    assert stream(spark, Fixture("realistic", 4, 500, 4)).orderBy("idx").collect() != one
    assert all(a.ts_ns <= b.ts_ns for a, b in zip(one, one[1:]))
    raw = spark.read.format("synthetic").options(mode="many-symbols", seed=1, messages=200, symbols=2).load()
    assert raw.select("locate").distinct().count() == 40 and raw.groupBy("locate").count().select("count").distinct().count() == 1
    with pytest.raises(Exception, match="mode is one of"):
        spark.read.format("synthetic").option("mode", "none").load().count()
    crossing = made(spark, "crossing", 3000)
    assert crossing.after.where("bid_qty > 0 AND ask_qty > 0 AND bid_px > ask_px").count() > 0


ANOMALIES = [
    ("A", 1, 1, None, "B", 100, 500), ("A", 1, 1, None, "B", 50, 600), ("A", 1, 2, None, "S", 0, 700), ("A", 70_000, 3, None, "S", 10, 700),
    ("X", 2, 1, None, None, 30, None), ("E", 1, 99, None, None, 10, None), ("U", 1, 1, 4, None, 0, 650), ("D", 1, 1, None, None, 0, None),
    ("A", 1, 1, None, "S", 10, 900), ("U", 1, 1, 1, None, 20, 800), ("E", 1, 1, None, None, 0, None), ("E", 1, 1, None, None, 25, None),
]


def test_anomalies(spark):
    found = fold.replay(messages(spark, ANOMALIES), by=()).orderBy("idx").collect()
    assert [r.outcome for r in found] == [
        "applied", "duplicate_ref", "zero_qty", "bad_locate", "applied", "unknown_ref", "zero_qty", "unknown_ref", "applied", "applied", "applied", "overfill",
    ]
    assert [r.mismatch for r in found].index(True) == 4 and sum(r.mismatch for r in found) == 1
    assert (found[4].bid_px, found[0].bid_qty) == (0, 100)  # the top is the message's own locate's
    assert (found[9].ask_px, found[9].ask_qty, found[11].live) == (800, 20, 0)
    assert lifecycle.duplicate_refs(messages(spark, ANOMALIES)).count() > 0


@pytest.mark.parametrize("rows", [ANOMALIES, [
    ("A", 1, 7, None, "B", 10, 5), ("E", 1, 7, None, None, 4, None), ("U", 1, 7, 8, None, 9, 6), ("U", 1, 8, 7, None, 3, 7), ("D", 1, 7, None, None, 0, None),
    ("A", 1, 9, None, "S", 1, 8), ("U", 1, 9, 8, None, 2, 9), ("A", 1, 8, None, "S", 1, 8), ("U", 1, 8, 8, None, 2, 9), ("X", 1, 8, None, None, 9, None),
]])
def test_references_that_repeat(spark, rows):
    """Joined lives and the fold agree on streams that break every rule."""
    s = Stream(messages(spark, rows))
    folded = fold.replay(s.messages, by=())
    assert lifecycle.counters(s.messages, s.life, s.effects).first().asDict() == fold.counters(folded).first().asDict()
    assert [tuple(r) for r in s.after.orderBy("idx").select("idx", *diff.TOP).collect()] == [tuple(r) for r in folded.orderBy("idx").select("idx", *diff.TOP).collect()]


def test_references_of_two_days(spark):
    rows = [("A", 1, 7, None, "B", 10, 5), ("D", 1, 7, None, None, 0, None), ("A", 1, 7, None, "B", 20, 6), ("E", 1, 7, None, None, 5, None)]
    df = messages(spark, rows).withColumn("session", F.when(F.col("idx") < 2, F.lit("2024-01-01")).otherwise("2024-01-02").cast("date"))
    s = Stream(df, ("session",))
    assert sorted((r.born, r.died, r.qty0) for r in s.life.collect()) == [(0, 1, 10), (2, None, 20)]
    assert s.effects.count() == 2 and s.remaining.first().rem == 15
    n = lifecycle.counters(s.messages, s.life, s.effects).first()
    assert (n.adds, n.deletes, n.executes, n.unknown_ref, n.duplicate_ref) == (2, 1, 1, 0, 0)
    # without days the second add is a use after death, which is no duplicate either
    assert sorted((r.born, r.died) for r in Stream(df).life.collect()) == [(0, 1), (2, None)]


def test_fixture_with_faults(spark):
    s = made(spark, "error-paths", 4000)
    folded = fold.replay(s.messages, by=())
    assert lifecycle.counters(s.messages, s.life, s.effects).first().asDict() == fold.counters(folded).first().asDict()


def test_priority_and_queries(spark):
    rows = [("A", 1, 1, None, "B", 100, 500), ("A", 1, 2, None, "B", 10, 500), ("X", 1, 1, None, None, 40, None), ("U", 1, 2, 3, None, 10, 500), ("A", 1, 4, None, "B", 5, 400)]
    s = Stream(messages(spark, rows))
    assert [tuple(r) for r in book.queue(s.remaining).where("price = 500").orderBy("place").select("ref", "rem").collect()] == [(1, 60), (3, 10)]
    assert [tuple(r) for r in book.depth(s.remaining).orderBy("rank").collect()] == [(1, "B", 1, 500, 70, 2), (1, "B", 2, 400, 5, 1)]
    assert book.find(s.life, s.effects, spark.createDataFrame([(2,), (1,)], "ref long"), idx=2).count() == 2
    assert book.live_running(s.messages, s.life).orderBy("idx").select("live").collect()[-1].live == 3


def test_planted_fault_is_found(spark):
    s = made(spark, "realistic", 3000)
    fault = Stream(diff.drop_cancels(s.messages, 1))
    first = diff.first_mismatch(s.after, fault.after).first()
    lost = s.messages.where("type = 'X'").agg(F.min("idx")).first()[0]
    assert first.idx >= lost
    slice_ = Stream(feed.by_locate(s.messages, first.locate, first.idx))
    broken = Stream(diff.drop_cancels(slice_.messages, 1))
    assert diff.first_mismatch(slice_.after, broken.after).first().idx == first.idx
    assert diff.counter_mismatches(lifecycle.counters(s.messages, s.life, s.effects), lifecycle.counters(fault.messages, fault.life, fault.effects)).count() > 0


def test_empty_stream(spark):
    s = Stream(messages(spark, [("A", 1, 1, None, "B", 100, 500)]).limit(0))
    assert s.life.count() == s.after.count() == s.before.count() == 0
    assert lifecycle.counters(s.messages, s.life, s.effects).first().adds == 0
    assert decide.digest(decide.orders(decide.signals(s.after))) == ("cbf29ce484222325", 0)


def test_strategy(spark):
    tops = spark.createDataFrame([(0, 1, 10, 400, 12, 100), (1, 1, 10, 400, 12, 100), (5, 1, 10, 100, 12, 400), (6, 1, 10, 400, 9, 1), (7, 2, 10, 9, 700, 1)], "idx long, locate int, bid_px long, bid_qty long, ask_px long, ask_qty long")
    cfg = decide.Strategy(cooldown=5)
    found = decide.signals(tops, cfg)
    assert [(r.idx, r.action, r.price) for r in found.orderBy("idx").collect()] == [(0, 1, 12), (1, 1, 12), (5, 2, 10)]
    assert [r.idx for r in decide.orders(found, cfg).orderBy("idx").collect()] == [0, 5]
    assert decide.digest(found)[1] == 3


def test_gaps_and_regressions(spark):
    df = spark.createDataFrame([(0, 5), (1, 4), (70_000, 9), (70_001, 8)], "idx long, ts_ns long")
    assert [tuple(r) for r in workload.gaps(df).collect()] == [(1, 69_998)]
    assert workload.regressions(df).first()[0] == 2


def test_windows_need_their_messages(spark):
    s = made(spark, "realistic", 300)
    with pytest.raises(ValueError):
        feed.window(s.messages, workload.CLOSE, 10)
    assert Counter(r.measured for r in feed.window(s.messages, 0, 100).collect()) == {True: 100}


def test_lifetimes_over_sessions(spark):
    rows = [("A", 1, 1, None, "B", 10, 500), ("A", 1, 2, None, "B", 10, 500), ("A", 1, 3, None, "B", 10, 500), ("D", 1, 1, None, None, 0, None), ("D", 1, 2, None, None, 0, None)]
    times = {0: ("2024-01-01", 50), 1: ("2024-01-01", 60), 2: ("2024-01-01", 61), 3: ("2024-01-01", 70), 4: ("2024-01-03", 10)}
    df = messages(spark, rows)
    session = F.coalesce(*[F.when(F.col("idx") == k, F.lit(d).cast("date")) for k, (d, _) in times.items()])
    ts = F.coalesce(*[F.when(F.col("idx") == k, F.lit(t).cast("long")) for k, (_, t) in times.items()])
    s = Stream(df.withColumn("session", session).withColumn("ts_ns", ts))
    got = workload.elapsed(s.messages, s.life).orderBy("lifetime").collect()
    assert [(r.days, r.lifetime) for r in got] == [(0, 20), (2, 2 * 86_400 * 10**9 - 50)]
    assert len(got) + s.remaining.count() == s.life.count() == 3
