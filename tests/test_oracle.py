"""Every registered query against its SQL twin on the correctness tables."""

import oracle
import pytest

from skyquilt.workload import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    _, rows, error = oracle.compare(spark, SF, catalog.QUERIES[name], catalog.ORACLES.get(name), con)
    assert error is None, error
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
