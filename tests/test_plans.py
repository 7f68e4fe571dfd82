"""What plans must look like: native, no products, filters at the scan."""

import re

import pytest

from quillbook.operators import book, feed, lifecycle, workload
from quillbook.plans.session import Stream
from quillbook.sources.fixture import Fixture, stream


@pytest.fixture(scope="module")
def s(spark):
    return Stream(stream(spark, Fixture("realistic", 1, 500, 3)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_and_without_products(s):
    frames = [
        lifecycle.effects(s.messages, s.life), book.level_changes(s.life, s.effects, ['locate']), workload.trading_state(s.messages),
        book.depth(s.remaining), book.live_running(s.messages, s.life), workload.distances(s.messages, s.effects, s.before),
        workload.symbol_activity(s.messages, s.life), workload.regressions(s.messages), workload.depth_snapshots(s.messages, s.life),
    ]
    for frame in frames:
        assert not re.search("Python|Pandas|CartesianProduct|BroadcastNestedLoop", plan(frame))


def test_filters_reach_the_scan(s):
    text = plan(feed.by_locate(s.messages, 2, 100).select("idx", "price"))
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(idx,100\)", text)
    assert re.search(r"ReadSchema: struct<idx:bigint,type:string,locate:int,price:bigint>", text)
