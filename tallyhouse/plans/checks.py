"""Quality and freshness of a lake's stored layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators import quality
from tallyhouse.operators.flatten import flatten
from tallyhouse.schemas import EVENT_DAY, NO_DAY
from tallyhouse.session import require_utc
from tallyhouse.sizing import sized_for_stored
from tallyhouse.sources.bronze import folder_day, read_bronze
from tallyhouse.sources.catalog import Lake, registered_days, stored_bytes
from tallyhouse.sources.manifest import manifest, record_landings


def quality_violations(lake: Lake) -> DataFrame:
    """Counts per rule, computed here under sizes fit to the fact."""
    size = stored_bytes(lake, "fct_transactions")
    with sized_for_stored(lake.spark, size):
        report = quality.quality_violations(
            lake.table("fct_transactions"), lake.table("dim_merchants"), lake.table("dim_customers")
        ).collect()
    # As literals: one short row per rule.
    rows = [
        F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["violations"]).cast("bigint").alias("violations"))
        for r in report
    ]
    return lake.spark.range(1).select(F.inline(F.array(*rows)))


def _days(lake: Lake, days: set[str]) -> DataFrame:
    listed = F.split(F.lit(",".join(sorted(days))), ",")
    return lake.spark.range(1).select(F.explode(listed).alias("dt")).where("dt != ''")


def unpromoted_days(lake: Lake, multi_line: bool = False) -> DataFrame:
    """Days of events in bronze that silver does not have.

    From the manifest, after it has been given the files it lacks; bronze itself is not read.
    """
    require_utc(lake.spark)
    record_landings(lake, multi_line)
    landed = manifest(lake).where("n_events > 0").select(
        F.coalesce(EVENT_DAY.name, F.lit(NO_DAY)).alias(EVENT_DAY.name)
    )
    promoted = registered_days(lake, "payments_events")
    return quality.days_behind(landed.distinct(), _days(lake, promoted))


def events_of_unpromoted_days(lake: Lake, multi_line: bool = False) -> DataFrame:
    """The events, flat, of the days that silver does not have.

    The manifest says which folders of bronze hold such days; Spark prunes the scan by
    them as it runs, so the others are not listed or opened. Events without a time are in
    no day.
    """
    record_landings(lake, multi_line)
    promoted = sorted(registered_days(lake, "payments_events"))
    behind = ~F.col(EVENT_DAY.name).isin(promoted) if promoted else F.lit(True)
    noted = manifest(lake).where(behind & (F.col("n_events") > 0))
    folders = noted.select(folder_day(F.col("file")).alias("folder")).distinct()
    bronze = read_bronze(lake.spark, lake.bronze, multi_line)
    events = flatten(bronze.join(folders, F.col(EVENT_DAY.name) == F.col("folder"), "left_semi"))
    return events.where(behind & F.col(EVENT_DAY.name).isNotNull())


def layer_freshness(lake: Lake, multi_line: bool = False) -> DataFrame:
    """The newest event of each layer.

    Of bronze from the manifest, after it has been given the files it lacks; silver lies
    by event day, so its newest day is enough.
    """
    require_utc(lake.spark)
    record_landings(lake, multi_line)
    newest_stored = max(registered_days(lake, "payments_events") - {NO_DAY}, default=None)
    silver = lake.table("payments_events").where(F.col("dt") == newest_stored)
    layers = [
        quality.newest_event("bronze", F.col("newest"), manifest(lake)),
        quality.newest_event("silver", F.col("event_timestamp"), silver),
        quality.newest_event(
            "gold", F.col("event_timestamp"), lake.table("payments_current")
        ),
    ]
    return reduce(DataFrame.unionByName, layers)
