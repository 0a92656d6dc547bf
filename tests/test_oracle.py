"""Every registered query against its DuckDB oracle (the driver's check), at sf0.001."""

import pytest

import __spark_entry__ as E
from feedlens.plans import catalog
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
SQLS = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(SQLS) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(SQLS) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(QUERIES[name](spark, SF), con, SQLS[name])
    assert r["ok"], r


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["company", "avg_sentiment"]
    assert df.count() > 0
