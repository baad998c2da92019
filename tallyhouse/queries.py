"""The registered queries, each a function of a session and a table folder.

Queries on stored layers share one lake per session and table folder, as they
would in use: it is landed and built once, in the shared folder the cluster
names, and then read.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import landing_day
from tallyhouse.operators import (
    activity,
    bitmaps,
    current_state,
    dimensions,
    flatten,
    quality,
    revenue,
)
from tallyhouse.plans import checks, jobs, layouts, lenient
from tallyhouse.schemas import EVENT, REVENUE
from tallyhouse.session import configure
from tallyhouse.sources import export, tables
from tallyhouse.sources.bronze import bronze_files, land_bronze, read_bronze
from tallyhouse.sources.catalog import (
    TABLES,
    Lake,
    create_table,
    location,
    register_days,
    sync_partitions,
)
from tallyhouse.streaming import arrivals
from tallyhouse.workspace import fresh_folder

# A day of the derived log, for the partition predicate.
ONE_DAY = "2001-07-31"
# Bronze of the queries is landed compressed: its lines repeat their names and many values.
LANDED_AS = "gzip"

_LANDED: dict[tuple[str, str], Lake] = {}
_LAGGING: dict[tuple[str, str], Lake] = {}
_PROMOTED: set[Lake] = set()
_BUILT: set[Lake] = set()
_OWN: dict[tuple[str, str, str], Lake] = {}
_DONE: set[tuple[Lake, str]] = set()
# One thread at a time builds a lake; others wait for it and then share it.
_BUILDING = threading.RLock()


def new_lake(spark: SparkSession) -> Lake:
    return Lake(configure(spark), fresh_folder(spark, "lake"), f"lake_{uuid.uuid4().hex[:12]}")


def landed_lake(spark: SparkSession, sf_dir: str) -> Lake:
    """A lake with the derived events in bronze."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _BUILDING:
        if key not in _LANDED:
            lake = new_lake(spark)
            jobs.ingest(lake, tables.bronze_events(spark, sf_dir), compression=LANDED_AS)
            _LANDED[key] = lake
        return _LANDED[key]


def promoted_lake(spark: SparkSession, sf_dir: str) -> Lake:
    """The same with silver."""
    with _BUILDING:
        lake = landed_lake(spark, sf_dir)
        if lake not in _PROMOTED:
            jobs.promote_silver(lake)
            _PROMOTED.add(lake)
        return lake


def built_lake(spark: SparkSession, sf_dir: str) -> Lake:
    """The same with gold."""
    with _BUILDING:
        lake = promoted_lake(spark, sf_dir)
        if lake not in _BUILT:
            jobs.build_current(lake)
            jobs.build_marts(lake, lake.table("payments_current"))
            _BUILT.add(lake)
        return lake


def lagging_lake(spark: SparkSession, sf_dir: str) -> Lake:
    """A lake whose bronze is ahead: what landed from ``ONE_DAY`` on is not promoted."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _BUILDING:
        if key not in _LAGGING:
            lake = new_lake(spark)
            events = tables.bronze_events(spark, sf_dir)
            early = F.col("event_timestamp") < ONE_DAY
            jobs.ingest(lake, events.where(early), compression=LANDED_AS)
            jobs.promote_silver_and_current(lake)
            jobs.ingest(lake, events.where(~early), compression=LANDED_AS)
            _LAGGING[key] = lake
        return _LAGGING[key]


def _own_lake(spark: SparkSession, sf_dir: str, name: str, build: Callable[[Lake], None]) -> Lake:
    """A lake of one query's own, built once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _BUILDING:
        if key not in _OWN:
            lake = new_lake(spark)
            build(lake)
            _OWN[key] = lake
        return _OWN[key]


def _once(lake: Lake, job: Callable[[Lake], object]) -> Lake:
    """A shared lake after a job that is run on it once."""
    with _BUILDING:
        if (lake, job.__name__) not in _DONE:
            job(lake)
            _DONE.add((lake, job.__name__))
        return lake


def _events(spark: SparkSession, sf_dir: str, created: str = "window") -> DataFrame:
    return tables.payment_events(configure(spark), sf_dir, created)


# Straight from the given tables.


def payment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir)


def payment_events_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "history")


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.event_days(flatten.with_event_day(_events(spark, sf_dir, "history")))


def fct_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_state.fct_transactions(_events(spark, sf_dir))


def payments_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_state.current_state(_events(spark, sf_dir))


def payments_current_max_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_state.current_state_by_max(_events(spark, sf_dir)).select(*EVENT.fieldNames())


def dim_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.dim_merchants(tables.merchants_of_orders(configure(spark), sf_dir))


def dim_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.dim_customers(tables.customers_of_orders(configure(spark), sf_dir))


def settled_revenue_by_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    paying = tables.merchants_of_orders(spark, sf_dir)
    return revenue.settled_revenue_by_merchant(
        current_state.narrow_fact(events, "amount", "merchant_id"), dimensions.dim_merchants(paying)
    )


def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.status_distribution(current_state.narrow_fact(_events(spark, sf_dir)))


def distinct_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.distinct_transactions(_events(spark, sf_dir))


def tied_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.tied_transactions(_events(spark, sf_dir))


# Through the stored layers.


def bronze_roundtrip_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = landed_lake(spark, sf_dir)
    return flatten.flatten(read_bronze(spark, lake.bronze))


def silver_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.silver_report(promoted_lake(spark, sf_dir))


def silver_one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = promoted_lake(spark, sf_dir).table("payments_events")
    return events.where(events.dt == ONE_DAY).drop("dt")


def registered_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver's folder under a new table whose days are registered one by one."""
    lake = promoted_lake(spark, sf_dir)
    table = "payments_events_registered"
    spark.sql(f"DROP TABLE IF EXISTS {lake.name(table)}")
    create_table(lake, table, location(lake, "payments_events"), TABLES["payments_events"])
    landed = activity.event_days(bronze_files(spark, lake.bronze)).collect()
    register_days(lake, table, [row["dt"] for row in landed])
    sync_partitions(lake, table)
    return activity.events_per_day(lake.table(table))


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promoted_lake(spark, sf_dir).table("payments_events")


def stored_fct_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_lake(spark, sf_dir).table("fct_transactions")


def stored_dim_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_lake(spark, sf_dir).table("dim_merchants")


def stored_dim_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_lake(spark, sf_dir).table("dim_customers")


def stored_payments_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_lake(spark, sf_dir).table("payments_current")


def stored_revenue_by_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.serve(built_lake(spark, sf_dir))


def serving_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = built_lake(spark, sf_dir)
    path = f"{lake.root}/results/settled_revenue_by_merchant"
    with _BUILDING:
        export.write_tsv(jobs.serve(lake), path)
    return export.read_tsv(spark, path, REVENUE).orderBy(F.desc("total_settled_amount"))


def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run(new_lake(spark), tables.bronze_events(configure(spark), sf_dir), LANDED_AS)


def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.quality_violations(built_lake(spark, sf_dir))


def layer_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.layer_freshness(lagging_lake(spark, sf_dir))


def unpromoted_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unpromoted_days(lagging_lake(spark, sf_dir))


def given_table_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on keys, on given tables that break them: orders without lines and the like."""
    orders = tables.given(configure(spark), sf_dir, "orders")
    lines = tables.given(spark, sf_dir, "lineitem")
    return (
        quality.unique("lineitem", lines, "l_orderkey")
        .unionByName(quality.unique("orders", orders, "o_custkey"))
        .unionByName(quality.resolves("orders", orders, {
            "o_orderkey": lines.select(F.col("l_orderkey").alias("o_orderkey")).distinct(),
        }))
    )


def _arrived_lake(spark: SparkSession, sf_dir: str) -> Lake:
    lake = landed_lake(spark, sf_dir)
    with _BUILDING:
        arrivals.promote_arrivals(lake)
    return lake


def current_from_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals.arrived_current(_arrived_lake(spark, sf_dir))


def revenue_from_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship from what has arrived: its current state and its log's merchants."""
    lake = _arrived_lake(spark, sf_dir)
    return revenue.settled_revenue_by_merchant(
        current_state.fact(arrivals.arrived_current(lake)),
        dimensions.dim_merchants(arrivals.arrived_log(lake)),
    )


# What landed broken, or with fields nobody declared; other layouts of silver.

BROKEN_FILES = "*.txt.gz"


def _order_number() -> Column:
    return F.substring("transaction_id", 5, 18).cast("long")


def quarantined_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that a bronze with cut lines and unreadable times leaves in quarantine.

    Of every fifty orders the lines of one are cut off, and the times of one are no times.
    """

    def build(lake: Lake) -> None:
        events = tables.bronze_events(lake.spark, sf_dir)
        kind, day = _order_number() % 50, landing_day(F.col("event_timestamp"))
        at = F.when(kind == 1, "soon").otherwise(F.col("event_timestamp"))
        line = F.to_json(F.struct(*[
            at.alias(c) if c == "event_timestamp" else F.col(c) for c in events.columns
        ]))
        cut = F.when(kind == 0, F.substring(line, F.lit(1), F.length(line) - 10)).otherwise(line)
        lines = events.select(cut.alias("value"), day.alias("dt"))
        writer = lines.write.mode("append").partitionBy("dt")
        writer.text(lake.bronze, compression=LANDED_AS)
        lenient.promote_with_quarantine(lake, pattern=BROKEN_FILES)

    lake = _own_lake(spark, sf_dir, "quarantine", build)
    return lake.table(lenient.QUARANTINED_EVENTS).select(
        F.regexp_extract("record", "txn_[0-9]+", 0).alias("transaction_id"), "reason", "dt"
    )


def events_without_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silver that the same promotion leaves: every event that could be read."""
    quarantined_events(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, "quarantine")
    return _OWN[key].table("payments_events")


def unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that no schema declares, asked for after promotion.

    Every third order has a device, and every merchant a terminal.
    """

    def build(lake: Lake) -> None:
        events, number = tables.bronze_events(lake.spark, sf_dir), _order_number()
        os = F.get(F.array(*map(F.lit, ("ios", "android", "web"))), (number % 9 / 3).cast("int"))
        device = F.struct(os.alias("os"), F.struct(number.alias("number")).alias("session"))
        grown = events.withColumn("device", F.when(number % 3 == 0, device)).withColumn(
            "merchant", F.col("merchant").withField("terminal", number % 7)
        )
        land_bronze(grown, lake.bronze, LANDED_AS)
        lenient.promote_openly(lake)

    events = _own_lake(spark, sf_dir, "unknown", build).table(lenient.OPEN_EVENTS)
    return events.select(
        "transaction_id", "event_type", "event_timestamp",
        F.variant_get("unknown", "$.device.os", "string").alias("device_os"),
        F.variant_get("unknown", "$.device.session.number", "bigint").alias("device_session"),
        F.variant_get("unknown", "$.merchant.terminal", "bigint").alias("terminal"),
    )


def compacted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver after three landings, promoted as they lie and then compacted."""

    def build(lake: Lake) -> None:
        events = tables.bronze_events(lake.spark, sf_dir)
        for nth in range(3):
            part = events.where(_order_number() % 3 == nth)
            jobs.ingest(lake, part, record=False, compression=LANDED_AS)
        jobs.promote_silver(lake, compact=False)
        layouts.compact_silver(lake)

    return _own_lake(spark, sf_dir, "compacted", build).table("payments_events")


def current_from_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current state from silver that lies by transaction: ranked without a shuffle."""
    lake = _once(promoted_lake(spark, sf_dir), layouts.cluster_events)
    return current_state.current_state(lake.table(layouts.CLUSTERED))


def distinct_transactions_by_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _once(promoted_lake(spark, sf_dir), layouts.note_bitmaps)
    return bitmaps.distinct_from_bitmaps(lake.table(layouts.BITMAPS))


def events_of_unpromoted_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.events_of_unpromoted_days(lagging_lake(spark, sf_dir))


REGISTERED = [
    payment_events,
    payment_events_history,
    event_days,
    fct_transactions,
    payments_current,
    payments_current_max_by,
    dim_merchants,
    dim_customers,
    settled_revenue_by_merchant,
    status_distribution,
    distinct_transactions,
    tied_transactions,
    bronze_roundtrip_flatten,
    silver_partition_counts,
    silver_one_day,
    registered_partitions,
    stored_events,
    stored_payments_current,
    stored_fct_transactions,
    stored_dim_merchants,
    stored_dim_customers,
    stored_revenue_by_merchant,
    serving_export,
    end_to_end,
    quality_violations,
    layer_freshness,
    unpromoted_days,
    given_table_violations,
    current_from_arrivals,
    revenue_from_arrivals,
    quarantined_events,
    events_without_quarantine,
    unknown_fields,
    compacted_events,
    current_from_clustered,
    distinct_transactions_by_bitmap,
    events_of_unpromoted_days,
]
