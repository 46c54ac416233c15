import pytest

from framelathe.queries import ORACLES, QUERIES
from tests.oracle import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    assert rows_of(QUERIES[name](spark, small)) == rows_of_sql(ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "passed" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
