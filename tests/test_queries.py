"""Every query with SQL against DuckDB; the others, whose operators are tested against plain versions, for rows that do not change from run to run."""

import pytest

import __spark_entry__
from lamina.plans import catalog, catalog_curation, catalog_geometry, catalog_streams  # noqa: F401
from tests.compare import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, data, name):
    found = catalog.QUERIES[name](spark, data)
    names, want = rows_of_sql(duck, catalog.SQL[name])
    assert sorted(found.columns) == names
    assert rows_of(found) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, data, name):
    found = catalog.QUERIES[name](spark, data)
    rows = rows_of(found)
    assert len(found.schema) and rows
    assert rows_of(catalog.QUERIES[name](spark, data)) == rows  # the same on each run


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
