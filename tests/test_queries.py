"""Every query of the library against its SQL, rows and column order alike."""

from __future__ import annotations

import pytest

from dqimpact import queries as package
from tests import compare

# Hundreds of fits each; test_learners.py and test_runner.py hold their parts against plain versions.
LONG = {"spark_ml_sweep", "ada_sweep", "knn_sweep"}
CASES = {name: (group.QUERIES[name], group.ORACLE.get(name)) for group in package.groups() for name in group.QUERIES}


@pytest.fixture(scope="module")
def connection(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", sorted(set(CASES) - LONG))
def test_rows_match_sql(spark, folder, connection, name):
    query, sql = CASES[name]
    df = query(spark, folder)
    names, rows = compare.rows_of_spark(df)
    assert rows, "the test tables give every query some rows"
    if sql is not None:
        assert df.columns == list(compare.types_of_duckdb(connection, sql))
        assert (names, rows) == compare.rows_of_duckdb(connection, sql)


def test_entry_registers_every_group():
    import __spark_entry__ as entry

    assert set(CASES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
