"""Every query that SQL can express against its DuckDB oracle, at sf0.001 (the driver uses sf0.01).

The library's own queries all have SQL.  Queries of optional subpackages
without SQL are held against brute force by the tests of those subpackages.
"""

import pytest
from conftest import SF_SMALL

import __spark_entry__ as E
from oracle_compare import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_own_query_has_an_oracle():
    assert E.own_queries().keys() <= E.oracle_sql().keys()
    assert E.oracle_sql().keys() <= E.queries().keys()


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, name, SF_SMALL, con)
    assert res["ok"], res
