"""Compaction, clustering, bitmaps and the manifest leave what silver says as it is."""

from pathlib import Path

from pyspark.sql import functions as F

from tallyhouse.operators import activity, bitmaps, current_state
from tallyhouse.plans import checks, jobs, layouts
from tallyhouse.sources import catalog, tables
from tallyhouse.sources.bronze import bronze_files
from tallyhouse.sources.manifest import manifest, manifest_of, record_landings
from tests.conftest import SF, event, plan_of, rows_of, write_bronze


def files_by_day(lake):
    days = {}
    for row in catalog.stored_files(lake, "payments_events").collect():
        days.setdefault(row["dt"], set()).add(row["path"])
    return days


def landed_thrice(spark, lake):
    events = tables.bronze_events(spark, SF)
    number = F.substring("transaction_id", 5, 12).cast("long")
    for nth in range(3):
        jobs.ingest(lake, events.where(number % 3 == nth), record=False)
    write_bronze(lake, [event("alone", at="2020-01-01T00:00:00Z"), event("never", at=None)])
    jobs.promote_silver(lake, compact=False)


def test_compaction_rewrites_days_with_small_files_alone(spark, lake, conf):
    conf("spark.sql.files.openCostInBytes", "64m")  # a file a task, so that days have several
    landed_thrice(spark, lake)
    before, rows = files_by_day(lake), rows_of(lake.table("payments_events"))
    assert len(before["2001-07-30"]) > 1 and len(before["2020-01-01"]) == 1
    days = layouts.compact_silver(lake)
    after = files_by_day(lake)
    assert "2020-01-01" not in days and "2001-07-30" in days
    for day in before:
        if day in days:
            assert len(after[day]) == 1 and not after[day] & before[day]
        else:
            assert after[day] == before[day]
    assert rows_of(lake.table("payments_events")) == rows
    assert layouts.compact_silver(lake) == [] and files_by_day(lake) == after
    # Later files of a compacted day, and a rebuild, lose and double nothing.
    jobs.promote_silver(lake)
    assert rows_of(lake.table("payments_events")) == rows


def test_bins_follow_the_sizes(spark):
    listed = [("d", f"p{n}", size) for n, size in enumerate([90, 40, 40, 30, 30, 30, 5])]
    files = spark.createDataFrame([*listed, ("e", "q", 10)], "dt string, path string, bytes long")
    bins = {r["path"]: r["bin"] for r in layouts._bins(files, 100).collect()}
    sizes = {}
    for _, path, size in listed:
        sizes[bins[path]] = sizes.get(bins[path], 0) + size
    assert bins["q"] == 0 and max(sizes.values()) <= 200 and len(sizes) == 3


def exchanges(frame):
    return plan_of(frame).count("Exchange (")


def test_clustered_silver_is_ranked_without_a_shuffle(spark, lake, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    jobs.ingest(lake, tables.bronze_events(spark, SF), record=False)
    write_bronze(lake, [event(None), event(None, "refunded"), event("other")])
    jobs.promote_silver_and_current(lake)
    layouts.cluster_events(lake, buckets=6)
    clustered = lake.table(layouts.CLUSTERED)
    assert exchanges(current_state.current_state(lake.table("payments_events"))) == 1
    ranked = current_state.current_state(clustered)
    assert exchanges(ranked) == 0 and "WindowGroupLimit" in plan_of(ranked)
    assert rows_of(ranked) == rows_of(lake.table("payments_current"))
    assert exchanges(activity.tied_transactions(clustered)) == 0
    counted = activity.distinct_transactions(clustered)
    assert exchanges(counted) == 1 and "SinglePartition" in plan_of(counted)
    # Built again over itself: the old one is read until the new one is in place.
    layouts.cluster_events(lake, buckets=3)
    assert rows_of(current_state.current_state(lake.table(layouts.CLUSTERED))) == rows_of(
        lake.table("payments_current")
    )


def test_bitmaps_count_odd_ids_exactly(spark):
    ids = ["txn_000000000001", "txn_000000000001", "txn_0000000000001", "txn_1000000000000",
           "txn_999999999999999999", "txn_32769", "x", "x", "", None, None, "txn_00000000000a"]
    events = spark.createDataFrame([(i, f"d{n % 3}") for n, i in enumerate(ids)],
                                   "transaction_id string, dt string")
    got = bitmaps.distinct_from_bitmaps(bitmaps.day_bitmaps(events)).first()
    assert tuple(got) == tuple(activity.distinct_transactions(events).first()) == (12, 8)
    none = events.where("false")
    assert tuple(bitmaps.distinct_from_bitmaps(bitmaps.day_bitmaps(none)).first()) == (0, 0)


def test_a_new_day_reads_that_day(spark, lake):
    write_bronze(lake, [event("txn_000000000001"), event("x")])
    jobs.promote_silver(lake)
    layouts.note_bitmaps(lake)
    write_bronze(lake, [event("txn_000000000001", "refunded", "2026-08-07T00:00:00Z"), event("y")])
    jobs.promote_silver(lake)
    before = {r["path"] for r in catalog.stored_files(lake, layouts.BITMAPS).collect()}
    layouts.note_bitmaps(lake, ["2026-08-07"])
    after = {r["path"] for r in catalog.stored_files(lake, layouts.BITMAPS).collect()}
    assert before < after
    counted = bitmaps.distinct_from_bitmaps(lake.table(layouts.BITMAPS)).first()
    assert tuple(counted) == (3, 2)
    layouts.note_bitmaps(lake)
    assert tuple(bitmaps.distinct_from_bitmaps(lake.table(layouts.BITMAPS)).first()) == (4, 3)


def test_the_manifest_reads_new_files_alone_and_equals_bronze(spark, lake):
    jobs.ingest(lake, tables.bronze_events(spark, SF))
    assert record_landings(lake) == 0
    write_bronze(lake, [event("t1"), event("t2", at=None), event("t3", at="2026-08-06T23:59:59-02:00")])
    Path(f"{lake.bronze}/dt=2026-08-06/empty.json").write_text("[]")
    landed = len(list(Path(lake.bronze).rglob("dt=202*/*.json")))
    assert record_landings(lake) == landed and record_landings(lake) == 0
    rebuilt = manifest_of(lake, bronze_files(spark, lake.bronze))
    assert rows_of(manifest(lake)) == rows_of(rebuilt)


def test_checks_do_not_read_bronze(spark, lake):
    jobs.ingest(lake, tables.bronze_events(spark, SF))
    jobs.promote_silver_and_current(lake)
    write_bronze(lake, [event("t1", at="2027-01-01T00:00:00Z"), event("t2", at=None)])
    days = checks.unpromoted_days(lake)
    assert [r["dt"] for r in days.collect()] == ["2027-01-01", catalog.schemas.NO_DAY]
    fresh = checks.layer_freshness(lake)
    newest = {r["layer"]: str(r["newest_event"]) for r in fresh.collect()}
    assert newest["bronze"].startswith("2027") and newest["silver"].startswith("2001")
    for plan in (plan_of(days), plan_of(fresh)):
        assert "json" not in plan.lower().replace(str(lake.root).lower(), "")


def test_days_of_another_table_prune_the_scan_as_it_runs(spark, lake):
    jobs.ingest(lake, tables.bronze_events(spark, SF))
    jobs.promote_silver_and_current(lake)
    write_bronze(lake, [event("t1", at="2027-01-01T00:00:00Z")])
    late = checks.events_of_unpromoted_days(lake)
    assert "dynamicpruning" in plan_of(late).lower()
    assert [(r["transaction_id"], r["dt"]) for r in late.collect()] == [("t1", "2027-01-01")]


def test_partitions_are_registered_in_chunks(spark, lake, monkeypatch):
    events = tables.bronze_events(spark, SF, "history")
    jobs.ingest(lake, events, record=False)
    jobs.promote_silver(lake)
    days = sorted(catalog.registered_days(lake, "payments_events"))
    assert len(days) > 1_000
    catalog.create_table(lake, "again", catalog.location(lake, "payments_events"),
                         catalog.TABLES["payments_events"])
    run_sql, statements = type(spark).sql, []

    def sql(self, text, *rest, **named):
        if " ADD IF NOT EXISTS" in text:
            statements.append(text.count("PARTITION ("))
            if len(statements) == 4:
                raise RuntimeError("driver lost")
        return run_sql(self, text, *rest, **named)

    monkeypatch.setattr(type(spark), "sql", sql)
    try:
        catalog.register_days(lake, "again", days)
    except RuntimeError:
        pass
    assert len(catalog.registered_days(lake, "again")) == 3 * catalog.CHUNK
    change = catalog.register_days(lake, "again", days)
    assert change == catalog.PartitionChange(len(days) - 3 * catalog.CHUNK, 3 * catalog.CHUNK)
    assert max(statements) <= catalog.CHUNK
    done = len(statements)
    assert catalog.register_days(lake, "again", days).added == 0 and len(statements) == done
    assert lake.table("again").count() == lake.table("payments_events").count()
