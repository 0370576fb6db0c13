"""Every query against its SQL on the smallest tables; those without SQL must run and give rows."""

import oracle
import pytest

import __spark_entry__ as entry
from plumbline.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, sf, con, name):
    assert oracle.difference(catalog.queries()[name](spark, sf), con, catalog.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def test_stream_equals_batch(spark, sf):
    stream, batch = (catalog.queries()[n](spark, sf) for n in ("st_monitor_stream", "st_monitor_batch"))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))
