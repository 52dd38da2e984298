"""Every library query with SQL gives DuckDB's rows; every other one gives rows with a stable schema."""

from __future__ import annotations

import compare
import pytest
from loomlog import queries as library
from loomlog import file_queries, report_queries, table_queries  # noqa: F401  (register their queries)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.views(SF)


@pytest.mark.parametrize("name", sorted(library.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert compare.differences(spark, con, library.QUERIES[name], library.ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLE_SQL)))
def test_runs(spark, name):
    df = library.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry_imports_and_has_the_library(spark):
    import __spark_entry__ as entry

    assert set(library.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
