"""What a task holds and what a landing writes, as tables grow."""

from __future__ import annotations

from pathlib import Path

from conftest import event, write_bronze
from pyspark.sql import functions as F

from tallyhouse import session, sizing
from tallyhouse.plans import jobs, lenient
from tallyhouse.sources import bronze
from tallyhouse.sources.bronze import LARGE_FILE, listing_of, read_bronze
from tallyhouse.sources.catalog import Lake, location
from tallyhouse.sources.manifest import manifest
from tallyhouse.streaming import arrivals


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def test_tasks_on_silver_sort_in_memory(spark):
    splits = lambda: int(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    with sizing.sized_for_stored(spark, 4 << 30):
        assert splits() == 32 * sizing.MB
        # 4 GB of silver are 18 GB shuffled: 128 MB a reducer.
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 144
    with sizing.sized_for(spark, 1 << 30, dense=sizing.GZIP_DENSE):
        assert splits() == 8 * sizing.MB
    assert session.PLANNING["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "64m"
    assert int(session.PLANNING["spark.sql.maxConcurrentOutputFileWriters"]) >= 9


def test_bronze_in_large_files_is_not_scattered(spark):
    def listed(*files):
        columns = "dt string, length bigint, file string"
        return listing_of(spark.createDataFrame([(d, n, f"{d}/{f}") for d, n, f in files], columns))

    text, zipped = LARGE_FILE, LARGE_FILE // sizing.GZIP_DENSE
    assert not listed(("a", 1, "1.json"), ("b", 1, "1.json")).scattered
    assert listed(("a", 1, "1.json"), ("a", 1, "2.json")).scattered
    assert not listed(("a", text, "1.json"), ("a", text, "2.json")).scattered
    large = listed(("a", zipped, "1.json.gz"), ("a", zipped, "2.json.gz"))
    assert (large.scattered, large.dense, large.size) == (False, sizing.GZIP_DENSE, 2 * zipped)


def test_compressed_bronze_is_read_by_every_job(spark, lake, tmp_path):
    write_bronze(lake, [event("t1"), event("t2", at="2026-08-05T01:00:00Z"), event("t1", "refunded")])
    events = read_bronze(spark, lake.bronze).drop("dt").cache()
    events.count()
    other = Lake(spark, str(tmp_path / "other"), f"{lake.database}_zipped")
    try:
        jobs.ingest(other, events, compression="gzip")
        landed = list(Path(other.bronze).glob("dt=*/part-*"))
        assert landed and all(f.name.endswith(".json.gz") for f in landed)
        assert manifest(other).agg(F.sum("n_events")).first()[0] == 3
        jobs.promote_silver_and_current(lake)
        jobs.promote_silver_and_current(other)
        for table in ("payments_events", "payments_current"):
            assert rows_of(other.table(table)) == rows_of(lake.table(table))
        arrivals.promote_arrivals(other)
        assert rows_of(arrivals.arrived_current(other)) == rows_of(lake.table("payments_current"))
        lenient.promote_openly(other)
        assert other.table(lenient.OPEN_EVENTS).count() == 3
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS `{other.database}` CASCADE")


def test_quarantine_of_large_files_is_written_as_it_lies(lake, monkeypatch):
    for part in ("1", "2"):
        write_bronze(lake, [event(f"t{part}"), event(f"bad{part}", at="2026-08-06 soon")], part)
    files = lambda: [
        len(list(Path(location(lake, table).removeprefix("file:")).rglob("*.parquet")))
        for table in ("payments_events", lenient.QUARANTINED_EVENTS)
    ]
    tables = lambda: [
        rows_of(lake.table(table)) for table in ("payments_events", lenient.QUARANTINED_EVENTS)
    ]
    lenient.promote_with_quarantine(lake)
    gathered = tables()
    assert files() == [1, 1] and [len(rows) for rows in gathered] == [2, 2]
    # Files that count as large: each split is written by the task that reads it.
    monkeypatch.setattr(bronze, "LARGE_FILE", 1)
    lenient.promote_with_quarantine(lake)
    assert files() == [2, 2] and tables() == gathered
