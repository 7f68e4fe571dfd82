import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbook.functions import histogram as H
from quillbook.operators import stats
from quillbook.sources import sinks

VALUES = [0, 1, 127, 128, 255, 256, 257, 511, 512, 10**6, 2**53 + 1, 2**62]


def test_buckets(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v long").select("v", H.bucket_of(F.col("v")).alias("b"))
    for r in df.select("v", H.lowest_of(F.col("b")).alias("low"), H.highest_of(F.col("b")).alias("high")).collect():
        assert r.low <= r.v <= r.high and (r.high - r.low) * 128 <= max(r.low, 1) and (r.v >= 256 or r.low == r.high)
    every = spark.range(0, 5000).select(H.bucket_of(F.col("id")).alias("b")).distinct().orderBy("b").collect()
    assert [r.b for r in every] == list(range(len(every)))


def test_quantiles_and_merge(spark):
    rng = np.random.default_rng(5)
    data = [(int(k), int(v)) for k, v in zip(rng.integers(0, 3, 3000), rng.integers(0, 100, 3000))]
    df = spark.createDataFrame(data, "k int, v long")
    hist = H.histogram(df, F.col("v"), "k")
    shares = {"low": 0.0, "mid": 0.5, "high": 0.9, "top": 1.0}
    whole = H.quantiles(H.merge(hist), shares).first()
    ordered = sorted(v for _, v in data)
    rank = lambda q: ordered[max(1, int(np.ceil(q * len(ordered)))) - 1]
    assert (whole.low, whole.mid, whole.high, whole.top, whole.n) == (ordered[0], rank(0.5), rank(0.9), ordered[-1], 3000)
    assert abs(whole.mean - np.mean(ordered)) < 1e-9
    assert H.quantiles(hist, shares, "k").count() == 3


def test_histogram_files(spark, tmp_path):
    hist = H.histogram(spark.range(300), F.col("id"))
    sinks.write_histogram(hist, str(tmp_path / "fast" / "run0.hist.csv"))
    back = sinks.read_histograms(spark, str(tmp_path / "*" / "*.hist.csv")).orderBy("low").collect()
    assert {(r.variant, r.run) for r in back} == {("fast", "run0")} and sum(r["count"] for r in back) == 300 and back[-1].high == 299
    one = spark.createDataFrame([(1, None, "a\"b")], "x int, y int, z string")
    sinks.write_json(one, str(tmp_path / "one"))
    assert sinks.read_json(spark, str(tmp_path / "one")).first().z == 'a"b'
    assert sinks.markdown(one).startswith("| x | y | z |")
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(5), 3)


def resampled(runs, rng):
    """Medians of plain resamples."""
    return np.median(rng.choice(runs, (stats.RESAMPLES, len(runs)), replace=True), axis=1)


def test_intervals(spark):
    rows = [("a", r, 10.0 + r) for r in range(10)] + [("b", r, 100.0 + r * r) for r in range(9)] + [("c", 0, 1.0), ("c", 1, None)]
    df = spark.createDataFrame(rows, "variant string, run int, p50 double")
    found = {r.variant: r for r in stats.intervals(df, "variant").collect()}
    rng = np.random.default_rng(stats.SEED)  # one generator, groups in order
    for name in "ab":
        runs = np.array([p for v, _, p in rows if v == name])
        assert np.allclose((found[name].p50_low, found[name].p50_high), np.quantile(resampled(runs, rng), [0.025, 0.975]))
        assert found[name].p50 == np.median(runs) and found[name].runs == len(runs)
    assert found["c"].p50 == 1 and np.isnan(found["c"].p50_low if found["c"].p50_low is not None else np.nan)
    (b,) = stats.against(df.where("variant <> 'c'"), "variant", "p50", "a").collect()
    rng = np.random.default_rng(stats.SEED)
    one, two = (np.array([p for v, _, p in rows if v == name]) for name in "ba")
    ratio = resampled(one, rng) / resampled(two, rng)
    assert np.allclose((b.ratio_low, b.ratio_high), np.quantile(ratio, [0.025, 0.975])) and b.ratio == np.median(one) / np.median(two)
    diff = resampled(one, rng) - resampled(two, rng)
    assert np.allclose((b.diff_low, b.diff_high), np.quantile(diff, [0.025, 0.975])) and b.significant


def test_too_many_runs(spark, monkeypatch):
    monkeypatch.setattr(stats, "MOST_RUNS", 1)
    with pytest.raises(ValueError):
        stats.intervals(spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "variant string, run int, p50 double"), "variant")


def test_gates_and_counters(spark):
    few = stats.run_quantiles(spark.range(100).select(F.col("id").alias("sample"), F.lit("v").alias("variant")), "variant").first()
    assert few.p50 == 49 and few.p99 is None
    row = spark.createDataFrame([(10, 20, 0, None)], "cycles long, instructions long, time_running_ns long, time_enabled_ns long")
    got = stats.per_operation(row, F.lit(5)).first()
    assert (got.cycles_per_op, got.ipc, got.ghz) == (2.0, 2.0, None)


def test_text_forms(spark):
    from quillbook.functions import text

    df = spark.createDataFrame([("09:30:01", 123_400, "run0_permsg.csv"), ("9:30", 1, "run0.csv")], "t string, p long, f string")
    got = df.select(
        text.clock_ns(F.col("t")).alias("ns"), text.price_text(F.col("p")).alias("p"), text.method_of(F.col("f")).alias("m"),
        text.variant_fields(text.variant_id(a=F.lit(1), b=F.lit("x"))).alias("v"),
    ).collect()
    assert [tuple(r) for r in got] == [(34_201 * 10**9, "12.3400", "permsg", {"a": "1", "b": "x"}), (None, "0.0001", "batch", {"a": "1", "b": "x"})]
    assert text.rotation(["a", "b", "c"], 4) == ["b", "c", "a"] and text.rotation([], 3) == []


def test_directory(spark):
    from quillbook.operators import directory

    rows = spark.createDataFrame(
        [(0, "R", 1, "ABC", 100, None, None), (1, "H", 1, None, None, "T", None), (2, "R", 1, "ABD", 10, None, None), (3, "S", 0, None, None, None, "Q"), (4, "H", 2, None, None, "H", None)],
        "idx long, type string, locate int, stock string, round_lot long, state string, event_code string",
    )
    names = directory.directory(rows)
    assert {r.locate: (r.symbol, r.round_lot, r.state, r.known) for r in names.collect()} == {1: ("ABD", 10, "T", True), 2: (None, None, "H", False)}
    assert directory.last_system_event(rows).first()[0] == "Q"
    assert {r.idx: r.symbol for r in directory.with_symbols(rows, names).collect()}[3] == ""
