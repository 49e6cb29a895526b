import pytest

from codemem.llm import registry
from tests.compare import connect, difference, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(spark_rows(registry.QUERIES[name](spark, sf_dir)), sql_rows(connect(sf_dir), registry.ORACLE_SQL[name])) is None
