"""Every registered query against its SQL, on the given tables."""

import pytest
from compare import connect, differences
from conftest import MEDIUM, SMALL

import __spark_entry__ as entry
from twinframe.plans.catalogue import QUERIES

# ten suppliers make every column categorical at the smallest scale; the SQL states the usual kinds
NEEDS_MORE_ROWS = {"synthesize_supplier"}


@pytest.fixture(scope="module")
def databases():
    return {folder: connect(folder) for folder in (SMALL, MEDIUM)}


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, databases, name):
    folder = MEDIUM if name in NEEDS_MORE_ROWS else SMALL
    found = differences(spark, databases[folder], entry.queries()[name], entry.oracle_sql()[name], folder)
    assert not found


def test_entry_has_a_row_per_column(spark):
    assert entry.entry(spark).count() == 3
