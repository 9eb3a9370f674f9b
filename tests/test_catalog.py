"""Queries with SQL against DuckDB on the smallest tables."""

import pytest
from oracle import agree

from quillstat import catalog

SF = "/root/testdata/sf0.001"


#: Many fits each: compared on the larger table when all queries are.
SLOW = {"search_grid", "search_validation_curve", "search_learning_curve", "stacking_regressor"}


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_query_matches_sql(spark, name):
    agree(spark, SF, catalog.queries()[name], catalog.oracle_sql()[name])


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
