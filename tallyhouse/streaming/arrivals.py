"""Arrival-driven promotion, beside the full rebuild.

Each run takes the bronze files that arrived since the last one and stops. What a batch
of them costs follows from the batch, not from what was promoted before.

The event log is kept in runs, a folder each: a batch is a run of its own, and ``FAN``
runs of one tier are folded into one of the next tier. An event is so written once for
each tier, the logarithm of the number of batches, and runs of old days are not touched
by new ones. Which runs make up the log is one property of the table: a fold is written
beside the runs it folds and takes their place in one statement, so a job that dies leaves
the old runs or the new one and no event is shown twice. Partitions in the catalog grow
with the days of the data and the tiers, not with the number of batches.

The current state is kept in buckets of transactions. A batch reads and writes only the
buckets it has transactions of; the others keep their files. Merging an event twice changes
nothing, so a batch that runs again after a failure gives the same. When buckets have
outgrown their size the whole state is written anew in more of them, which happens at
every fourfold growth.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyhouse.operators.activity import event_days
from tallyhouse.operators.current_state import current_state, in_buckets, merged_state
from tallyhouse.operators.flatten import flatten
from tallyhouse.plans.jobs import build_marts
from tallyhouse.schemas import BRONZE_STORED, BUCKET, EVENT, EVENT_DAY, NO_DAY, SILVER_STORED
from tallyhouse.session import require_utc
from tallyhouse.sizing import MB, day_partitions, sized_for, sized_for_stored
from tallyhouse.sources.bronze import JSON_FILES, bronze_files, listing_of
from tallyhouse.sources.catalog import (
    STORED_BYTES,
    Lake,
    TableSpec,
    add_partitions,
    create_database,
    create_table,
    drop_partitions,
    folder_bytes,
    property_of,
    publish,
    replace_partitions,
    set_properties,
    stored_bytes,
    stored_files,
)

RUN = StructField("run", StringType())
ARRIVED = "arrived_events"
ARRIVED_SPEC = TableSpec(
    StructType([*SILVER_STORED.fields, RUN]), "silver/arrived", (RUN.name, EVENT_DAY.name)
)
ARRIVED_CURRENT = "arrived_current"
CURRENT_SPEC = TableSpec(
    StructType([*EVENT.fields, BUCKET]), "gold/arrived_current", (BUCKET.name,)
)
#: Runs of one tier that are folded into one of the next.
FAN = 8
#: Bytes of a bucket when the state is divided anew, how often it may outgrow them, and
#: the bounds of the number of buckets.
BUCKET_BYTES = 256 * MB
OUTGROWN = 4
BUCKETS = (16, 4_096)

_LIVE, _BUCKETS = "lake.live.runs", "lake.buckets"

#: First and last batch of a run.
Run = tuple[int, int]


def _name(run: Run) -> str:
    return f"{run[0]}-{run[1]}"


def live_runs(lake: Lake) -> list[Run]:
    """The runs that make up the log, oldest first."""
    noted = property_of(lake, ARRIVED, _LIVE) if lake.exists(ARRIVED) else None
    return [tuple(map(int, run.split("-"))) for run in noted.split(",")] if noted else []


def arrived_log(lake: Lake) -> DataFrame:
    """Every event promoted so far, with its day."""
    live = [_name(run) for run in live_runs(lake)]
    log = lake.table(ARRIVED).where(F.col(RUN.name).isin(live))
    return log.select(*SILVER_STORED.fieldNames())


def arrived_current(lake: Lake) -> DataFrame:
    """The current state of what has arrived."""
    return lake.table(ARRIVED_CURRENT).select(*EVENT.fieldNames())


def _run_folder(lake: Lake, run: Run) -> str:
    return f"{lake.root}/{ARRIVED_SPEC.folder}/{RUN.name}={_name(run)}"


def _write_run(lake: Lake, run: Run, events: DataFrame, scattered: bool = True) -> None:
    """Write a run and register its days; it is no part of the log yet.

    Events that are ``scattered`` over small files are gathered by day.
    """
    own = _run_folder(lake, run)
    if scattered:
        events = events.hint("rebalance", day_partitions(lake.spark), EVENT_DAY.name)
    (
        events.write.mode("overwrite")
        .option("compression", "snappy")
        .partitionBy(EVENT_DAY.name)
        .parquet(own)
    )
    create_table(lake, ARRIVED, f"{lake.root}/{ARRIVED_SPEC.folder}", ARRIVED_SPEC)
    written = event_days(lake.spark.read.schema(SILVER_STORED).parquet(own)).collect()
    add_partitions(lake, ARRIVED, [
        {RUN.name: _name(run), EVENT_DAY.name: row[EVENT_DAY.name] or NO_DAY} for row in written
    ])


def _set_live(lake: Lake, runs: list[Run]) -> None:
    set_properties(lake, ARRIVED, {_LIVE: ",".join(_name(run) for run in sorted(runs))})


def _append_batch(lake: Lake, batch: DataFrame, batch_id: int, scattered: bool) -> None:
    """Add a batch to the log, unless it is part of it already."""
    live = live_runs(lake)
    if any(first <= batch_id <= last for first, last in live):
        return
    own = (batch_id, batch_id)
    _write_run(lake, own, batch, scattered)
    _set_live(lake, [*live, own])


def _tier(run: Run) -> int:
    batches, tier = run[1] - run[0] + 1, 0
    while batches >= FAN:
        batches, tier = batches // FAN, tier + 1
    return tier


def _full_tier(runs: list[Run]) -> list[Run]:
    """The first FAN neighbouring runs of one tier, of the lowest tier that has as many."""
    for tier in sorted({_tier(run) for run in runs}):
        own = [run for run in runs if _tier(run) == tier]
        if len(own) >= FAN:
            return own[:FAN]
    return []


def fold_runs(lake: Lake) -> None:
    """Put runs together while a tier has ``FAN`` of them; others are not touched."""
    while folded := _full_tier(live := live_runs(lake)):
        size = sum(folder_bytes(lake.spark, _run_folder(lake, run)) for run in folded)
        names = [_name(run) for run in folded]
        with sized_for_stored(lake.spark, size):
            own = (folded[0][0], folded[-1][1])
            events = lake.table(ARRIVED).where(F.col(RUN.name).isin(names))
            _write_run(lake, own, events.select(*SILVER_STORED.fieldNames()))
        _set_live(lake, [*(run for run in live if run not in folded), own])
    _forget_folded(lake)


def _known_runs(lake: Lake) -> dict[str, list[str]]:
    """The days the catalog knows of each run."""
    known: dict[str, list[str]] = {}
    for row in lake.spark.sql(f"SHOW PARTITIONS {lake.name(ARRIVED)}").collect():
        run, day = (level.partition("=")[2] for level in row["partition"].split("/"))
        known.setdefault(run, []).append(day)
    return known


def _forget_folded(lake: Lake) -> None:
    """Drop partitions of runs that are no part of the log, also those a dead job left."""
    live = {_name(run) for run in live_runs(lake)}
    drop_partitions(lake, ARRIVED, [
        {RUN.name: run, EVENT_DAY.name: day}
        for run, days in _known_runs(lake).items() if run not in live for day in days
    ])


def buckets_for(size: int) -> int:
    """Buckets of BUCKET_BYTES, a power of two within the bounds."""
    fewest, most = BUCKETS
    return min(max(1 << math.ceil(math.log2(max(size / BUCKET_BYTES, 1))), fewest), most)


def _merge_current(lake: Lake, batch: DataFrame, size: int) -> None:
    """Merge a batch of ``size`` bytes into the buckets of its transactions."""
    events = batch.select(*EVENT.fieldNames())
    if not lake.exists(ARRIVED_CURRENT):
        _divide(lake, current_state(events), size)
        return
    buckets = int(property_of(lake, ARRIVED_CURRENT, _BUCKETS))
    before = stored_bytes(lake, ARRIVED_CURRENT)
    whole = before + size
    if whole > buckets * BUCKET_BYTES * OUTGROWN and buckets < buckets_for(whole):
        _divide(lake, current_state(events.unionByName(arrived_current(lake))), whole)
        return
    # At most the number of buckets reaches the driver.
    touched = in_buckets(events, buckets).select(BUCKET.name).distinct().collect()
    touched = sorted(row[BUCKET.name] for row in touched)
    own = F.col(BUCKET.name).isin(touched)
    old = _bytes(lake, own) if touched else 0
    with sized_for_stored(lake.spark, old + size):
        merged = merged_state(lake.table(ARRIVED_CURRENT).where(own), events, buckets)
        replace_partitions(lake, ARRIVED_CURRENT, merged, BUCKET.name, touched)
    if touched:
        now = str(before - old + _bytes(lake, own))
        set_properties(lake, ARRIVED_CURRENT, {STORED_BYTES: now})


def _bytes(lake: Lake, own) -> int:
    files = stored_files(lake, ARRIVED_CURRENT, own)
    return files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def _divide(lake: Lake, current: DataFrame, size: int) -> None:
    """Write the whole state in as many buckets as its size asks for."""
    buckets = buckets_for(size)
    with sized_for_stored(lake.spark, size):
        rows = in_buckets(current, buckets).hint("rebalance", buckets, BUCKET.name)
        publish(lake, ARRIVED_CURRENT, rows, CURRENT_SPEC, {_BUCKETS: str(buckets)})


def build_marts_from_arrivals(lake: Lake) -> None:
    """The fact and dimensions from what has arrived, without a rebuild of silver."""
    build_marts(
        lake, arrived_current(lake), arrived_log(lake), stored_bytes(lake, ARRIVED_CURRENT)
    )


def promote_batch(
    lake: Lake, batch: DataFrame, batch_id: int, scattered: bool = True
) -> None:
    """Promote the flat events of one batch; again after a failure, it changes nothing."""
    _append_batch(lake, batch, batch_id, scattered)
    own = next(run for run in live_runs(lake) if run[0] <= batch_id <= run[1])
    # A run that holds later batches too has them merged a second time.
    events = lake.table(ARRIVED).where(F.col(RUN.name) == _name(own))
    _merge_current(lake, events, folder_bytes(lake.spark, _run_folder(lake, own)))
    fold_runs(lake)


def promote_arrivals(
    lake: Lake, files_per_batch: int | None = None, multi_line: bool = False
) -> None:
    """Promote the bronze files that have not been promoted yet, then stop.

    Without ``files_per_batch`` all of them are one batch. ``multi_line`` reads
    pretty-printed arrays.
    """
    require_utc(lake.spark)
    create_database(lake)
    reader = (
        lake.spark.readStream.schema(BRONZE_STORED)
        .option("pathGlobFilter", JSON_FILES)
        .option("mode", "FAILFAST")
        .option("multiLine", multi_line)
    )
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    landed = listing_of(bronze_files(lake.spark, lake.bronze))
    stream = (
        reader.json(lake.bronze)
        .writeStream.foreachBatch(
            lambda bronze, batch_id: promote_batch(
                lake, flatten(bronze), batch_id, landed.scattered
            )
        )
        .option("checkpointLocation", f"{lake.root}/checkpoints/arrivals")
        .trigger(availableNow=True)
    )
    # A stream keeps the settings it was started under.
    with sized_for(lake.spark, landed.size, dense=landed.dense):
        query = stream.start()
    query.awaitTermination()
