"""Bronze to silver to gold to the serving query.

Landing appends and is never repeated by the jobs. Everything after it rebuilds
its tables in full from the layer before, so any job can be run again.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators import current_state as state
from tallyhouse.operators.activity import events_per_day
from tallyhouse.operators.dimensions import dim_customers, dim_merchants
from tallyhouse.operators.flatten import flatten
from tallyhouse.operators.revenue import settled_revenue_by_merchant
from tallyhouse.schemas import EVENT_DAY
from tallyhouse.session import require_utc
from tallyhouse.sizing import day_partitions, sized_for, sized_for_stored
from tallyhouse.sources.bronze import bronze_files, land_bronze, listing_of, read_bronze
from tallyhouse.sources.catalog import (
    Lake,
    PartitionChange,
    publish,
    put_in_place,
    stage,
    stored_bytes,
)
from tallyhouse.sources.manifest import record_landings

# Marts are independent of each other; two are built at a time.
MART_THREADS = 2


def has_rows(frame: DataFrame) -> bool:
    """Whether there is any row; tries one split, and more only while none has a row.

    ``DataFrame.isEmpty`` would ask every split for its first row.
    """
    return bool(frame.select(F.lit(1)).head(1))


def ingest(
    lake: Lake, events: DataFrame, record: bool = True, compression: str | None = None
) -> None:
    """Land events and record them in the manifest, which reads the new files once."""
    land_bronze(events, lake.bronze, compression)
    if record:
        record_landings(lake)


def promote_silver(
    lake: Lake, compact: bool = True, multi_line: bool = False
) -> PartitionChange | None:
    """Rebuild the silver event log from all of bronze; None if there is none.

    ``compact`` shuffles events to their day so that a day's many bronze objects
    become few files, unless they are few already; without it the promotion has no
    shuffle and each split of an input becomes a file. ``multi_line`` reads bronze of pretty-printed arrays.
    """
    require_utc(lake.spark)
    landed = listing_of(bronze_files(lake.spark, lake.bronze))
    if not landed.size:
        return None
    bronze = read_bronze(lake.spark, lake.bronze, multi_line)
    if not has_rows(bronze):
        return None
    with sized_for(lake.spark, landed.size, dense=landed.dense):
        silver = flatten(bronze)
        if compact and landed.scattered:
            silver = silver.hint("rebalance", day_partitions(lake.spark), EVENT_DAY.name)
        return publish(lake, "payments_events", silver)


def silver_report(lake: Lake) -> DataFrame:
    """Events per day as stored; only row counts are read from the files."""
    return events_per_day(lake.table("payments_events"))


def build_current(lake: Lake) -> None:
    """Rebuild the current state of every transaction from silver."""
    size = stored_bytes(lake, "payments_events")
    with sized_for_stored(lake.spark, size):
        publish(lake, "payments_current", state.current_state(lake.table("payments_events")))


def promote_silver_and_current(
    lake: Lake, compact: bool = True, multi_line: bool = False
) -> PartitionChange | None:
    """Both in one go; current state reads the silver just written, not bronze again."""
    change = promote_silver(lake, compact, multi_line)
    if change is not None:
        build_current(lake)
    return change


def build_marts(
    lake: Lake,
    current: DataFrame | None = None,
    events: DataFrame | None = None,
    events_bytes: int | None = None,
) -> None:
    """Rebuild the fact and both dimensions: all are written, then all put in place.

    The fact is a projection of the current state. A caller that has just built
    that passes it, and the event log is not ranked a second time. ``events`` is
    another log than silver, of ``events_bytes``.
    """
    if events is None:
        events, events_bytes = lake.table("payments_events"), stored_bytes(lake, "payments_events")
    size = events_bytes or 0
    marts = {
        "fct_transactions": state.fct_transactions(events) if current is None else state.fact(current),
        "dim_merchants": dim_merchants(events),
        "dim_customers": dim_customers(events),
    }
    with (
        sized_for_stored(lake.spark, size),
        ThreadPoolExecutor(MART_THREADS) as pool,
    ):
        writes = [pool.submit(stage, lake, name, rows) for name, rows in marts.items()]
        staged = [write.result() for write in writes]
    for mart in staged:
        put_in_place(lake, mart)


def table_counts(lake: Lake, *tables: str) -> DataFrame:
    """Stored rows of tables, one row each; only row counts are read from the files."""
    counts = [
        lake.table(name).agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(name).alias("table"), "n_rows")
        for name in tables
    ]
    return reduce(DataFrame.unionByName, counts)


def serve(lake: Lake) -> DataFrame:
    """Settled revenue by merchant from the stored marts."""
    return settled_revenue_by_merchant(lake.table("fct_transactions"), lake.table("dim_merchants"))


def run(lake: Lake, events: DataFrame, compression: str | None = None) -> DataFrame:
    """All steps in order, stopping at the first that fails."""
    ingest(lake, events, record=False, compression=compression)
    if promote_silver_and_current(lake) is None:
        raise ValueError(f"no events under {lake.bronze}")
    build_marts(lake, lake.table("payments_current"))
    return serve(lake)
