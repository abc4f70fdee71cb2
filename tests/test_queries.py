"""Every registered query against its oracle on whole tables."""

import pytest

import __spark_entry__ as entry
from tests import harness

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return harness.connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns, got = harness.spark_rows(df)
    oracle = entry.oracle_sql()
    if name not in oracle:
        assert got
        return
    wanted_columns, wanted = harness.duck_rows(con, oracle[name])
    assert columns == wanted_columns
    assert got == wanted


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
