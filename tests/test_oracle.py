"""Every registered query against its DuckDB oracle (exact, order-insensitive)."""

import pytest

from cabflow.plans.check import compare, duckdb_connect
from cabflow.plans.oracle import oracle_sql
from cabflow.plans.queries import QUERIES

from conftest import SF_SMALL


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duckdb_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    result = compare(spark, name, SF_SMALL, con)
    assert result["ok"], result
