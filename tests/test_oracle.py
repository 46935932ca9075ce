from __future__ import annotations

import pytest

from compare import SMALL, database, rows_of_spark, rows_of_sql
from vignette import catalog


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert rows_of_spark(catalog.queries()[name](spark, SMALL)) == rows_of_sql(con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.queries()) <= set(e.queries())


def test_nothing_imports_the_text_operators():
    import pathlib

    root = pathlib.Path(catalog.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
