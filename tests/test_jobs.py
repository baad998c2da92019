"""The jobs end to end: rerun, rebuild, late events, and what each one touches."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyhouse.plans import checks, jobs
from tallyhouse.schemas import EVENT, FACT, SILVER_STORED, types_of
from tallyhouse.sources import tables
from tallyhouse.sources.catalog import (
    PartitionChange,
    folder_bytes,
    location,
    registered_days,
    stored_bytes,
)
from tests.conftest import SF, event, rows_of, write_bronze

LAYERS = [
    "payments_events", "payments_current", "fct_transactions", "dim_merchants", "dim_customers",
]


def history():
    return [
        event("t1", "created", "2026-08-01T09:00:00Z"),
        event("t1", "authorized", "2026-08-01T09:01:00Z"),
        event("t1", "settled", "2026-08-02T09:00:00Z"),
        event("t2", "created", "2026-08-02T10:00:00Z", merchant={"merchant_id": "m2", "name": "B"}),
        event("t2", "authorized", "2026-08-02T10:00:30Z", merchant={"merchant_id": "m2", "name": "B"}),
        event("t2", "failed", "2026-08-03T10:00:00Z", merchant={"merchant_id": "m2", "name": "B"}),
    ]


def build(lake):
    change = jobs.promote_silver_and_current(lake)
    jobs.build_marts(lake, lake.table("payments_current"))
    return change


def contents(lake):
    return {name: rows_of(lake.table(name)) for name in LAYERS}


def test_build_and_rerun(lake):
    write_bronze(lake, history())
    assert build(lake) == PartitionChange(added=3, existing=0, removed=0)
    first = contents(lake)
    assert len(first["payments_events"]) == 6
    assert len(first["payments_current"]) == len(first["fct_transactions"]) == 2
    # A second run registers nothing new and leaves every layer as it was.
    assert build(lake) == PartitionChange(added=0, existing=3, removed=0)
    assert contents(lake) == first


def test_tables_note_the_size_of_their_files(spark, lake):
    write_bronze(lake, history())
    build(lake)
    for table in LAYERS:
        folder = Path(location(lake, table).removeprefix("file:"))
        size = sum(f.stat().st_size for f in folder.rglob("*.parquet"))
        assert stored_bytes(lake, table) == size > 0


def test_a_missing_note_is_listed_and_not_taken_for_nothing(spark, lake):
    write_bronze(lake, history())
    build(lake)
    size = stored_bytes(lake, "payments_events")
    spark.sql(f"ALTER TABLE {lake.name('payments_events')} UNSET TBLPROPERTIES ('lake.stored.bytes')")
    assert stored_bytes(lake, "payments_events") == size
    assert folder_bytes(spark, location(lake, "payments_events")) == size


def test_declared_schemas_are_stored(lake):
    write_bronze(lake, history())
    build(lake)
    assert types_of(lake.table("payments_events").schema) == types_of(SILVER_STORED)
    assert types_of(lake.table("payments_current").schema) == types_of(EVENT)
    assert types_of(lake.table("fct_transactions").schema) == types_of(FACT)


def test_rebuild_of_all_derived_layers_from_bronze(spark, lake):
    write_bronze(lake, history())
    build(lake)
    first = contents(lake)
    spark.sql(f"DROP DATABASE `{lake.database}` CASCADE")
    build(lake)
    assert contents(lake) == first


def test_late_events_join_their_own_day(lake):
    write_bronze(lake, history())
    build(lake)
    write_bronze(lake, [event("t3", "created", "2026-08-01T23:00:00Z")])
    assert build(lake) == PartitionChange(added=0, existing=3, removed=0)
    days = {r["dt"]: r["n_events"] for r in jobs.silver_report(lake).collect()}
    assert days == {"2026-08-01": 3, "2026-08-02": 3, "2026-08-03": 1}
    assert lake.table("fct_transactions").count() == 3


def test_events_without_a_time_are_kept(spark, lake):
    from tests.conftest import bronze_frame

    jobs.ingest(lake, bronze_frame(spark, [event("t1"), event("t2", at=None)]).drop("dt"))
    assert jobs.promote_silver_and_current(lake) == PartitionChange(2, 0, 0)
    assert {r["dt"]: r["n_events"] for r in jobs.silver_report(lake).collect()} == {
        "2026-08-06": 1, None: 1,
    }
    assert lake.table("payments_current").count() == 2


def test_vanished_day_is_gone_after_a_rebuild(lake, tmp_path):
    write_bronze(lake, history())
    build(lake)
    folder = tmp_path / "lake/bronze/payments"
    (folder / "dt=2026-08-03").rename(tmp_path / "lake/vanished")
    assert build(lake) == PartitionChange(added=0, existing=2, removed=1)
    assert registered_days(lake, "payments_events") == {"2026-08-01", "2026-08-02"}
    assert lake.table("payments_events").count() == 5


def test_marts_from_silver_equal_marts_from_current(lake):
    write_bronze(lake, history())
    build(lake)
    reused = rows_of(lake.table("fct_transactions"))
    jobs.build_marts(lake)
    assert rows_of(lake.table("fct_transactions")) == reused


def test_landing_appends_and_is_not_idempotent(spark, lake):
    events = tables.bronze_events(spark, SF)
    jobs.ingest(lake, events)
    jobs.promote_silver_and_current(lake)
    once = rows_of(lake.table("payments_current"))
    n = lake.table("payments_events").count()
    jobs.ingest(lake, events)
    jobs.promote_silver_and_current(lake)
    assert lake.table("payments_events").count() == 2 * n
    assert rows_of(lake.table("payments_current")) == once


def test_run_equals_the_query_on_derived_events(spark, lake):
    from tallyhouse import queries

    stored = jobs.run(lake, tables.bronze_events(spark, SF))
    direct = queries.settled_revenue_by_merchant(spark, SF)
    assert [tuple(r) for r in stored.collect()] == [tuple(r) for r in direct.collect()]


def test_run_stops_without_events(spark, lake):
    with pytest.raises(ValueError, match="no events"):
        jobs.run(lake, tables.bronze_events(spark, SF).where("false"))


def test_counts_agree_across_layers(spark, lake):
    jobs.run(lake, tables.bronze_events(spark, SF))
    silver, fact = lake.table("payments_events"), lake.table("fct_transactions")
    assert silver.count() == tables.bronze_events(spark, SF).count()
    distinct = silver.select("transaction_id").distinct().count()
    assert fact.count() == lake.table("payments_current").count() == distinct
    assert fact.where("status = 'settled'").count() == sum(
        r["settled_transactions"] for r in jobs.serve(lake).collect()
    )
    assert checks.quality_violations(lake).where("violations > 0").count() == 0


def files_per_day(lake):
    folder = Path(location(lake, "payments_events").removeprefix("file:"))
    return {d.name: len(list(d.glob("*.parquet"))) for d in folder.glob("dt=*")}


def test_many_objects_of_a_day_become_one_file(lake, conf):
    """Eight runs land two days each; packed as one object per task they stay apart."""
    conf("spark.sql.files.openCostInBytes", "1m")
    for run in range(8):
        write_bronze(
            lake,
            [event(f"t{run}", at=at) for at in ("2026-08-01T10:00:00Z", "2026-08-02T10:00:00Z")],
        )
    jobs.promote_silver(lake, compact=False)
    scattered, rows = files_per_day(lake), rows_of(lake.table("payments_events"))
    jobs.promote_silver(lake)
    assert files_per_day(lake) == {"dt=2026-08-01": 1, "dt=2026-08-02": 1}
    assert sum(scattered.values()) > 2
    assert rows_of(lake.table("payments_events")) == rows and len(rows) == 16


def test_submitted_steps(spark, lake):
    import job
    from tallyhouse.schemas import REVENUE
    from tallyhouse.sources.export import read_tsv

    write_bronze(lake, history())
    job.run(lake, ["silver", "current", "marts", "quality", "serve"])
    result = read_tsv(spark, f"{lake.root}/results/settled_revenue_by_merchant", REVENUE)
    assert rows_of(result) == rows_of(jobs.serve(lake)) == [("Shop", "retail", 1, 10.5)]


def test_pretty_printed_arrays_go_through_the_jobs(spark, lake, capsys):
    import job
    from tests.conftest import write_text

    pretty = json.dumps(history()[:2], indent=2)
    write_text(f"{lake.bronze}/dt=2026-08-01/a.json", pretty)
    write_text(f"{lake.bronze}/dt=2026-08-02/b.json", json.dumps(history()[2:], indent=2))
    job.run(lake, ["silver", "current", "marts", "arrivals", "arrived_marts", "quality", "serve"], True)
    assert lake.table("payments_events").count() == 6
    assert checks.unpromoted_days(lake, multi_line=True).count() == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[:4] == [
        "days added 3, existing 0, removed 0",
        "2026-08-01: 2 rows", "2026-08-02: 3 rows", "2026-08-03: 1 rows",
    ]
    assert "payments_events: 6 rows" in lines and "payments_current: 2 rows" in lines
    assert "fct_transactions: 2 rows" in lines and lines[-1] == "result: 1 rows"


def test_marts_are_put_in_place_together(lake, monkeypatch):
    write_bronze(lake, history())
    build(lake)
    before = contents(lake)
    write_bronze(lake, [event("t9", "settled", merchant={"merchant_id": "m9", "name": "New"})])
    jobs.promote_silver_and_current(lake)
    broken = lake.table("payments_current").withColumn(
        "amount", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        jobs.build_marts(lake, broken)
    for table in ("fct_transactions", "dim_merchants", "dim_customers"):
        assert rows_of(lake.table(table)) == before[table]
    jobs.build_marts(lake, lake.table("payments_current"))
    assert lake.table("dim_merchants").count() == 3


def test_offsets_land_under_the_day_silver_gives_them(spark, lake):
    from tests.conftest import bronze_frame

    late = event("t1", at="2026-08-06T23:30:00-05:00")
    jobs.ingest(lake, bronze_frame(spark, [late]).drop("dt"))
    assert [d.name for d in Path(lake.bronze).glob("dt=*")] == ["dt=2026-08-07"]
    jobs.promote_silver(lake)
    assert registered_days(lake, "payments_events") == {"2026-08-07"}
    assert checks.unpromoted_days(lake).count() == 0
