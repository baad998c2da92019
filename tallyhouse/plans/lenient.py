"""Promotions that keep what the strict one refuses or ignores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.operators.flatten import flatten_openly
from tallyhouse.operators.quarantine import QUARANTINED, sorted_out
from tallyhouse.plans.jobs import has_rows
from tallyhouse.schemas import EVENT_DAY, QUARANTINE, SILVER_OPEN
from tallyhouse.session import require_utc
from tallyhouse.sizing import day_partitions, sized_for
from tallyhouse.sources.bronze import (
    JSON_FILES,
    bronze_files,
    listing_of,
    read_bronze_leniently,
    read_bronze_texts,
)
from tallyhouse.sources.catalog import (
    FOLDERS,
    STORED_BYTES,
    TABLES,
    Lake,
    PartitionChange,
    Staged,
    TableSpec,
    create_database,
    create_table,
    folder_bytes,
    location,
    publish,
    put_in_place,
)

QUARANTINED_EVENTS = "quarantined_events"
QUARANTINE_SPEC = TableSpec(QUARANTINE, "silver/sorted", (EVENT_DAY.name,))
OPEN_EVENTS = "open_events"
OPEN_SPEC = TableSpec(SILVER_OPEN, "silver/open", (EVENT_DAY.name,))


def promote_with_quarantine(
    lake: Lake, multi_line: bool = False, pattern: str = JSON_FILES
) -> PartitionChange | None:
    """Rebuild silver from what can be read of bronze, and a table of what cannot.

    Bronze is read once: both parts are one write, split by a partition folder, and each
    part's folder is put in its table's place. As in the strict promotion, rows are shuffled
    to their day only if bronze lies in many small files. With nothing to promote silver stays as it
    is and None is returned; the quarantine is renewed all the same.
    """
    require_utc(lake.spark)
    landed = listing_of(bronze_files(lake.spark, lake.bronze, pattern))
    if not landed.size:
        return None
    create_database(lake)
    root = f"{lake.root}/{QUARANTINE_SPEC.folder}"
    live = [location(lake, table) or "" for table in ("payments_events", QUARANTINED_EVENTS)]
    used = {name for name in FOLDERS if any(f"{root}/{name}/" in f"{at}/" for at in live)}
    # Both tables are put in place after the write, so at most one folder is in use.
    folder = f"{root}/{FOLDERS[1] if FOLDERS[0] in used else FOLDERS[0]}"
    with sized_for(lake.spark, landed.size, dense=landed.dense):
        parts = sorted_out(read_bronze_leniently(lake.spark, lake.bronze, multi_line, pattern))
        if landed.scattered:
            keys = (QUARANTINED, EVENT_DAY.name)
            parts = parts.hint("rebalance", day_partitions(lake.spark), *keys)
        (
            parts.write.mode("overwrite").option("compression", "snappy")
            .partitionBy(QUARANTINED, EVENT_DAY.name).parquet(folder)
        )
    written = lake.spark.read.parquet(folder)
    bad, good = (f"{folder}/{QUARANTINED}={value}" for value in ("true", "false"))
    is_bad = F.col(QUARANTINED).cast("boolean")  # a folder's name, read as text
    if has_rows(written.where(is_bad)):
        put_in_place(lake, Staged(QUARANTINED_EVENTS, QUARANTINE_SPEC, bad, {}))
    else:
        lake.spark.sql(f"DROP TABLE IF EXISTS {lake.name(QUARANTINED_EVENTS)}")
        create_table(lake, QUARANTINED_EVENTS, bad, QUARANTINE_SPEC)
    if not has_rows(written.where(~is_bad)):
        return None
    noted = {STORED_BYTES: str(folder_bytes(lake.spark, good))}
    return put_in_place(lake, Staged("payments_events", TABLES["payments_events"], good, noted))


def promote_openly(lake: Lake) -> PartitionChange | None:
    """Silver with the fields that the declared schema lacks, as a table of its own.

    Same events and columns as silver, and ``unknown`` beside them. Each event is parsed
    for both, so this is for bronze whose producers add fields.
    """
    require_utc(lake.spark)
    landed = listing_of(bronze_files(lake.spark, lake.bronze))
    if not landed.size:
        return None
    texts = read_bronze_texts(lake.spark, lake.bronze)
    if not has_rows(texts):
        return None
    with sized_for(lake.spark, landed.size, dense=landed.dense):
        events = flatten_openly(texts)
        if landed.scattered:
            events = events.hint("rebalance", day_partitions(lake.spark), EVENT_DAY.name)
        return publish(lake, OPEN_EVENTS, events, OPEN_SPEC)
