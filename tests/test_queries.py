"""Every registered query against its SQL at the smallest scale."""

import pytest

from codelattice import catalog
from tests.compare import connection, spark_rows, sql_rows

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(connection(sf_dir), ORACLE[name])


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
