"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from loglattice.catalog import MODULES

SF = "/root/testdata/sf0.001"
SQLS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(SQLS))
def test_query_agrees_with_its_sql(spark, con, name):
    ok, _, _, message = compare(spark, con, name, entry.queries()[name], SQLS[name], SF)
    assert ok and not message, message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["time", "level", "count"] and df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQLS) <= set(entry.queries())


def test_every_query_of_the_catalog_has_sql():
    assert {n for m in MODULES for n in m.QUERIES} <= set(SQLS)
