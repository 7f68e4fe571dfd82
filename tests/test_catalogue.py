import pytest

import __spark_entry__ as entry
from quillbook.plans import catalogue

from oracle import connect, same

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, db, name):
    same(spark, db, catalogue.QUERIES[name], catalogue.SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["locate", "side", "rank", "price", "qty", "orders"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
