"""Every core query against its SQL on DuckDB; those without SQL must run."""

import pytest

from strandloom.plans.registry import MODULES
from tests.oracle import compare, connect

QUERIES = {n: f for m in MODULES for n, f in m.queries().items()}
SQL = {n: s for m in MODULES for n, s in m.oracle_sql().items()}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, con, name):
    got, want, extra, missing = compare(QUERIES[name](spark, data), SQL[name], con)
    assert got == want and not extra and not missing, (extra, missing)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
