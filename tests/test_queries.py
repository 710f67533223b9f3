"""Every registered query of the library against its DuckDB SQL."""

import oracle
import pytest

from graphloom.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, sf_dir, con, name):
    _, differs = oracle.compare(registry.queries()[name](spark, sf_dir), con, registry.oracle_sql()[name])
    assert not differs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
