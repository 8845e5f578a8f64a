import pytest

from rankloom.plans import analysis, fits, pooling, reporting, scoring
from tests.oracle import check

QUERIES = {**scoring.QUERIES, **analysis.QUERIES, **fits.QUERIES, **reporting.QUERIES, **pooling.QUERIES}
SQL = {**scoring.ORACLE_SQL, **analysis.ORACLE_SQL, **fits.ORACLE_SQL, **reporting.ORACLE_SQL, **pooling.ORACLE_SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    check(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.001" if name not in ("judge_overlap", "sign_flips") else "/root/testdata/sf0.01")
