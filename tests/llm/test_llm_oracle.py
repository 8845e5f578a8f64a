import pytest

from rankloom.llm import queries
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.01")
