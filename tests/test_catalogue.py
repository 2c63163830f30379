"""Every registered query against its SQL in DuckDB, on the smallest data."""

import pytest

import __spark_entry__ as contract
import checking

SF_DIR = contract.SMOKE_DIR


@pytest.fixture(scope="module")
def connection():
    return checking.connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(contract.spark_queries.queries()) == set(contract.duckdb_sql.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).columns == ["request_id", "rank", "id"]


@pytest.mark.parametrize("name", sorted(contract.duckdb_sql.oracle_sql()))
def test_query(spark, connection, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert not checking.differences(df, connection, contract.oracle_sql()[name])
