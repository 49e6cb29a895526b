import pytest

import __spark_entry__ as entry
from codemem.plans.views import VIEWS, Tables, view_sql
from tests.compare import connect, difference, rows, spark_rows, sql_rows

from codemem.plans import oracles, queries as registered

QUERIES, SQL = registered.REGISTRY, oracles.build()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_the_entry_registers_them():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert difference(spark_rows(QUERIES[name](spark, sf_dir)), sql_rows(con, SQL[name])) is None


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_view_is_the_same_in_both_engines(spark, sf_dir, con, name):
    assert difference(spark_rows(getattr(Tables(spark, sf_dir), name)), sql_rows(con, view_sql(name))) is None


def test_entry(spark):
    top = entry.entry(spark)
    got = top.orderBy("rank").collect()
    assert 1 <= len(got) <= 3 and [r["rank"] for r in got] == sorted(r["rank"] for r in got)
    assert got[0].score > 0


def test_comparison_sees_differences():
    a = (["x"], rows(["x"], [(1,), (2,)]))
    assert difference(a, (["y"], a[1])) and difference(a, (["x"], rows(["x"], [(1,), (3,)])))
    assert difference(a, (["x"], rows(["x"], [(1,)]))) and difference(a, a) is None
