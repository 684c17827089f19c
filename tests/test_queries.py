"""Every query with SQL gives DuckDB's rows; the others give some."""

import pytest
from conftest import SMALL, rows_of

from pagewright import catalog

catalog.load()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    mine, theirs = catalog.QUERIES[name](spark, SMALL).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows(spark, name):
    """What they give is derived anew in test_brute.py; no page of the table restates itself."""
    assert catalog.QUERIES[name](spark, SMALL).count() > 0 or name == "restated_blocks"


def test_sql_needs_no_session():
    assert all(isinstance(v, str) for v in catalog.ORACLE_SQL.values())
