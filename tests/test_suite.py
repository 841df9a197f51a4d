"""Every registered query with a SQL twin gives the rows DuckDB gives."""

import pytest
from compare import compare, connect

from sharewise.suite import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
