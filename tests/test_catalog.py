"""Databases, tables, partitions, and replacing a table."""

import contextlib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallyhouse.operators.flatten import flatten
from tallyhouse.schemas import EVENT, SILVER_STORED, types_of
from tallyhouse.sources import catalog
from tallyhouse.sources.catalog import PartitionChange
from tests.conftest import bronze_frame, event, rows_of

DAYS = ["2026-08-01", "2026-08-02", "2026-08-03"]


def silver(spark, days=DAYS):
    return flatten(bronze_frame(spark, [event(f"t{d}", at=f"{d}T10:00:00Z") for d in days]))


@pytest.fixture
def stored(spark, lake):
    """Silver written by another job: a folder that no table names yet."""
    folder = f"{lake.root}/outside"
    silver(spark).write.partitionBy("dt").parquet(folder)
    catalog.create_database(lake)
    catalog.create_table(lake, "payments_events", folder)
    return lake


def test_tables_have_the_declared_columns(lake):
    catalog.create_database(lake)
    catalog.create_database(lake)
    for table, spec in catalog.TABLES.items():
        catalog.create_table(lake, table, f"{lake.root}/{table}")
        catalog.create_table(lake, table, f"{lake.root}/{table}")
        assert types_of(lake.table(table).schema) == types_of(spec.schema)
        assert lake.table(table).count() == 0


def test_rows_are_visible_once_partitions_are_registered(stored):
    assert stored.table("payments_events").count() == 0
    change = catalog.register_days(stored, "payments_events", DAYS[:2])
    assert change == PartitionChange(added=2, existing=0)
    assert stored.table("payments_events").count() == 2
    change = catalog.register_days(stored, "payments_events", DAYS)
    assert change == PartitionChange(added=1, existing=2)
    change = catalog.register_days(stored, "payments_events", DAYS)
    assert change == PartitionChange(added=0, existing=3)
    assert stored.table("payments_events").count() == 3


def test_registering_no_days_is_fine(stored):
    assert catalog.register_days(stored, "payments_events", []) == PartitionChange(0, 0)


def test_more_days_than_one_catalog_call_takes(stored):
    days = [f"19{y:02d}-01-{d:02d}" for y in range(10) for d in range(1, 29)]
    assert catalog.register_days(stored, "payments_events", days).added == 280
    assert len(catalog.registered_days(stored, "payments_events")) == 280


def test_other_registration_errors_are_raised(stored):
    with pytest.raises(AnalysisException):
        catalog.register_days(stored, "no_such_table", DAYS)


def test_sync_adds_and_removes(stored, tmp_path):
    assert catalog.sync_partitions(stored, "payments_events") == PartitionChange(3, 0, 0)
    (tmp_path / "lake/outside" / f"dt={DAYS[0]}").rename(tmp_path / "lake/gone")
    assert catalog.sync_partitions(stored, "payments_events") == PartitionChange(0, 2, 1)
    assert stored.table("payments_events").count() == 2


def test_day_stays_a_string(stored):
    catalog.sync_partitions(stored, "payments_events")
    assert dict(stored.table("payments_events").dtypes)["dt"] == "string"


def test_publish_alternates_between_two_folders(spark, lake):
    seen = []
    for _ in range(3):
        catalog.publish(lake, "payments_events", silver(spark))
        seen.append(catalog.location(lake, "payments_events").rsplit("/", 1)[1])
    assert seen == ["blue", "green", "blue"]


def test_table_without_partitions_is_pointed_at_its_new_folder(spark, lake):
    events = silver(spark).drop("dt")
    seen = []
    for rows in (events, events.limit(1), events):
        catalog.publish(lake, "payments_current", rows)
        folder = catalog.location(lake, "payments_current").rsplit("/", 1)[1]
        seen.append((folder, lake.table("payments_current").count()))
    assert seen == [("blue", 3), ("green", 1), ("blue", 3)]


def test_table_with_other_columns_is_replaced(spark, lake):
    catalog.create_database(lake)
    spark.sql(f"CREATE TABLE {lake.name('payments_current')} (a INT) USING parquet")
    catalog.publish(lake, "payments_current", silver(spark).drop("dt"))
    assert types_of(lake.table("payments_current").schema) == types_of(EVENT)


def test_publish_may_read_the_table_it_replaces(spark, lake):
    catalog.publish(lake, "payments_events", silver(spark))
    doubled = lake.table("payments_events").unionByName(lake.table("payments_events"))
    catalog.publish(lake, "payments_events", doubled)
    assert lake.table("payments_events").count() == 6


def test_failed_publish_keeps_the_table(spark, lake):
    catalog.publish(lake, "payments_events", silver(spark))
    before = rows_of(lake.table("payments_events"))
    broken = silver(spark).withColumn("amount", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        catalog.publish(lake, "payments_events", broken)
    assert rows_of(lake.table("payments_events")) == before


def test_interrupted_swap_is_finished_by_the_next_publish(spark, lake):
    catalog.publish(lake, "payments_events", silver(spark))
    live = catalog.location(lake, "payments_events")
    building = "payments_events__building"
    spark.sql(f"ALTER TABLE {lake.name('payments_events')} RENAME TO {lake.name(building)}")
    assert catalog.property_of(lake, building, catalog.COMPLETE) == "true"
    catalog.publish(lake, "payments_events", silver(spark, DAYS[:1]))
    assert lake.table("payments_events").count() == 1
    assert catalog.location(lake, "payments_events") != live
    assert not lake.exists(building)


def test_undeclared_schema_is_refused(spark, lake):
    with pytest.raises(ValueError, match="declared"):
        catalog.publish(lake, "payments_events", silver(spark).drop("currency"))
    with pytest.raises(ValueError, match="declared"):
        catalog.publish(
            lake, "payments_events", silver(spark).withColumn("amount", F.col("amount").cast("int"))
        )
    assert not lake.exists("payments_events")


def test_one_schema_feeds_all(spark):
    flat = silver(spark)
    assert types_of(flat.schema) == types_of(SILVER_STORED)
    assert EVENT.fieldNames() + ["dt"] == flat.columns


class Died(Exception):
    pass


@pytest.mark.parametrize("first_build", [True, False])
@pytest.mark.parametrize("dies_before", range(12))
def test_death_between_any_two_statements(spark, lake, monkeypatch, first_build, dies_before):
    """The job dies, the next one fails as well: readers see a whole table or none."""
    if not first_build:
        catalog.publish(lake, "payments_events", silver(spark))
    statements = spark.sql
    left = [dies_before]

    def sql(text, *args, **named):
        if left[0] == 0:
            raise Died
        left[0] -= 1
        return statements(text, *args, **named)

    monkeypatch.setattr(spark, "sql", sql)
    with contextlib.suppress(Died):
        catalog.publish(lake, "payments_events", silver(spark, DAYS[:2]))
    monkeypatch.setattr(spark, "sql", statements)
    broken = silver(spark).withColumn("amount", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        catalog.publish(lake, "payments_events", broken)
    if lake.exists("payments_events"):
        assert lake.table("payments_events").count() in ({2} if first_build else {2, 3})
    else:
        assert first_build
    catalog.publish(lake, "payments_events", silver(spark, DAYS[:1]))
    assert lake.table("payments_events").count() == 1
