"""All registered queries against their SQL on the smallest tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        ok, message, _ = compare(df, con, SQL[name])
        assert ok, message
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
