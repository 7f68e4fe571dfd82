"""What only shows in large tables: locates of several feeds, sums and products beyond
64 bits, and books that stand still over many checkpoints."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillbook.functions import codec
from quillbook.functions import histogram as H
from quillbook.operators import book, diff, stats
from quillbook.plans import catalogue
from quillbook.plans.session import Stream
from quillbook.sources.fixture import Fixture, stream

from oracle import connect, same

DATA = "/root/testdata/sf0.001"
OVER_FEEDS = ["book_counters", "coverage", "crossed_events", "crossed_locked", "depth_final", "depth_invariants", "depth_snapshots", "depth_top5", "distance_ways", "find_orders", "invariant_buckets", "distance_hist", "decode_roundtrip", "framed_scan"]


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """A folder whose events have users on both sides of 65,536."""
    folder = tmp_path_factory.mktemp("wide")
    for name in os.listdir(DATA):
        if name != "events.parquet":
            os.symlink(f"{DATA}/{name}", folder / name)
    duckdb.sql(f"COPY (SELECT * REPLACE (user_id + 65528 AS user_id) FROM '{DATA}/events.parquet') TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", OVER_FEEDS)
def test_locates_of_several_feeds(spark, wide, name):
    same(spark, connect(wide), catalogue.QUERIES[name], catalogue.SQL[name], wide)


def test_locate_through_a_header(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 65_535, 65_536, 90_000, 2**31 - 1, -1)], "locate int")
    parts = codec.of_feed(F.col("locate"))
    found = rows.select("locate", codec.over_feeds(parts["locate"], parts["tracking"]).alias("back"), *[v.alias(f"half_{k}") for k, v in parts.items()])
    assert all(r.locate == r.back and 0 <= r.half_locate < 65_536 and 0 <= r.half_tracking < 65_536 for r in found.collect())


def test_mean_of_a_sum_beyond_64_bits(spark):
    rows = spark.createDataFrame([(2**62 + x,) for x in range(4)], "v long")
    found = H.quantiles(H.histogram(rows, F.col("v")), {"p50": 0.5}).first()
    assert (found.n, found.mean, found.max) == (4, float(2**62), 2**62 + 3)


def test_rank_sum_of_many_samples(spark):
    n = 2_100_000  # n * n * 2n exceeds 64 bits
    rows = spark.range(2 * n).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), F.floor(F.col("id") / 2 % 7).alias("sample"))
    found = stats.mann_whitney(rows, "g", "a", "b").first()
    assert (found.u, found.z) == (n * n / 2, 0.0)


@pytest.fixture(scope="module")
def s(spark):
    return Stream(stream(spark, Fixture("error-paths", 1, 600, 4)))


def _cuts(s, every):
    places = [r.idx for r in s.messages.where(book.is_book()).select("idx").orderBy("idx").collect()]
    return [*places[every - 1::every], *([places[-1]] if len(places) % every else [])]


def test_depths_at_checkpoints(s):
    found = sorted(tuple(r) for r in diff.checkpoint_depths(s.messages, s.life, s.effects, 150).collect())
    plain = [(cut, *r) for cut in _cuts(s, 150) for r in book.depth(book.remaining(s.life, s.effects, cut)).collect()]
    assert found == sorted(plain) and found


def test_differences_at_checkpoints(s):
    fault = Stream(diff.drop_cancels(s.messages, 1))
    books = [(x.life, x.effects) for x in (s, fault)]
    plain = diff.depth_mismatches(*[diff.checkpoint_depths(s.messages, *x, 50) for x in books], ("cut",))
    found = diff.checkpoint_mismatches(s.messages, books, 50).select(plain.columns)
    key = repr
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key) and plain.count()
    first = diff.checkpoint_mismatches(s.messages, books, 50, first=True)
    at = plain.agg(F.min("cut")).first()[0]
    parts = [sorted((r.locate, r.side, r.rank) for r in x.where(F.col("cut") == at).collect()) for x in (first, plain)]
    assert first.agg(F.min("cut")).first()[0] == at and parts[0] == parts[1]


def test_checkpoints_are_written_out_last(s):
    """Rows for every checkpoint are made after all shuffles, in the step that returns them."""
    text = diff.checkpoint_depths(s.messages, s.life, s.effects, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in text and not re.search("Exchange hashpartitioning", text[:text.index("Generate")])
