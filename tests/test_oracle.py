"""Every registered query at sf0.001, against DuckDB where it has a statement."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        error, _ = compare(df, con, ORACLES[name])
        assert not error, error
    else:
        df.collect()
