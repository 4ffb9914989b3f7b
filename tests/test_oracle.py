"""Every registered query against its DuckDB statement, and the shape of every plan."""

import pytest

import __spark_entry__ as entry
from houselights import catalog
from houselights.oracle.compare import connect, differences

QUERIES = catalog.QUERIES
STATEMENTS = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_same_rows(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, STATEMENTS[name]) is None


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_inventory_line_has_a_query():
    from houselights.catalog import COVERS

    shown = {line for lines in COVERS.values() for line in lines.split()}
    sizes = {"S": 14, "P": 24, "J": 14, "A": 18, "W": 9, "O": 5, "U": 6, "F": 15, "B": 20, "Q": 55, "M": 11, "T": 7}
    assert {f"{kind}{i}" for kind, n in sizes.items() for i in range(1, n + 1)} <= shown
