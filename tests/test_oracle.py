"""Every registered query against its SQL, by full content."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tallyhouse import queries as registered
from tallyhouse.schemas import REVENUE, types_of
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    connection.execute("set timezone = 'UTC'")
    return connection


# Queries of the part that can be taken out are tested with it.
OWN = [query.__name__ for query in registered.REGISTERED]


def test_every_query_has_sql():
    assert set(OWN) <= set(contract.queries()) and set(OWN) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, name):
    result = contract.queries()[name](spark, SF)
    columns = sorted(result.columns)
    actual = [tuple(row) for row in result.select(*columns).collect()]
    expected = duck.execute(contract.oracle_sql()[name])
    assert sorted(c[0] for c in expected.description) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = duck.execute(f"select {quoted} from ({contract.oracle_sql()[name]})").fetchall()
    assert len(actual) == len(expected) > 0
    assert sorted(actual, key=repr) == sorted(expected, key=repr)


def test_entry(spark):
    result = contract.entry(spark)
    assert types_of(result.schema) == types_of(REVENUE)
    totals = [row["total_settled_amount"] for row in result.collect()]
    assert totals == sorted(totals, reverse=True) and totals


def test_known_counts(spark):
    """Counts worked out beforehand for the derived log."""
    counts = contract.queries()["status_distribution"](spark, SF).collect()
    assert {r["status"]: r["n"] for r in counts} == {"settled": 1395, "failed": 27, "refunded": 78}
    total = contract.queries()["distinct_transactions"](spark, SF).first()
    assert tuple(total) == (4578, 1500)
