"""The registered queries against their SQL, by full content."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tallyhouse.llm import queries
from tests.conftest import SF

NAMES = [query.__name__ for query in queries.REGISTERED]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def test_all_are_registered():
    assert set(NAMES) | {"pipeline"} <= set(contract.queries())
    assert [int(name[2:].split("_")[0]) for name in NAMES] == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(NAMES) & set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    result = contract.queries()[name](spark, SF)
    columns = sorted(result.columns)
    actual = [tuple(row) for row in result.select(*columns).collect()]
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = duck.execute(f"select {quoted} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert len(actual) == len(expected) > 0
    assert sorted(actual, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", ["op5_mix_sources", "op9_decontaminate", "op11_fill_in_middle"])
def test_native_plans_run_no_python(spark, name):
    from tests.conftest import plan_of

    plan = plan_of(contract.queries()[name](spark, SF))
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))
