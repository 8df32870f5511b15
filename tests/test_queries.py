"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
SQLS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = oracle.spark_result(entry.queries()[name](spark, SF))
    if name in SQLS:
        assert oracle.difference(got, oracle.duck_result(con, SQLS[name])) is None


def test_every_twin_has_a_query():
    assert set(SQLS) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
