"""Every registered query against its SQL statement in DuckDB, at the smallest scale."""

import pytest

from wtel.fixtures import registry
from wtel.fixtures.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_equals_oracle(spark, con, key):
    result = compare(spark, con, SF_DIR, key)
    assert result["rows"] > 0
    assert result["ok"], result


def test_every_query_has_a_statement():
    assert set(registry.STATEMENTS) == set(registry.QUERIES)
