"""Every registered query of the engine against its SQL."""

import pytest

from tessera.queries import ORACLES, QUERIES

from oracle import DATA, assert_same


def test_each_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    assert assert_same(QUERIES[name](spark, DATA), ORACLES[name]) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
