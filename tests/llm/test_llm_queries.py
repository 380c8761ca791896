"""Every query of the subpackage against its SQL on DuckDB; those without SQL must run and hold what they promise."""

import pytest

from strandloom.llm import queries as L
from tests.oracle import compare, connect

SQL = L.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, con, name):
    got, want, extra, missing = compare(L.queries()[name](spark, data), SQL[name], con)
    assert got == want and not extra and not missing, (extra, missing)


@pytest.mark.parametrize("name", sorted(set(L.queries()) - set(SQL)))
def test_runs(spark, data, name):
    df = L.queries()[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()
