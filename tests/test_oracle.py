"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

from barwright import catalog
from tests import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.duck(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, sf, name):
    n, err = oracle.compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES.get(name), sf)
    assert err is None, err
    assert n >= 0


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
