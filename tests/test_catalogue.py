"""Every registered query of the engine against its SQL oracle."""

import pytest
from oracle import DATA, assert_same, connection

from strandlog.catalogue import ORACLES, QUERIES

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert_same(spark, con, QUERIES[name], ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["tbl", "key"]
