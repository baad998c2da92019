"""Jobs that change how silver lies, not what it says."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.operators.bitmaps import day_bitmaps
from tallyhouse.schemas import EVENT, EVENT_DAY, SILVER_STORED
from tallyhouse.sizing import MB, PARQUET_DENSE, SHUFFLED_PER_STORED, reducers, sized_for_stored
from tallyhouse.sources.catalog import (
    Lake,
    TableSpec,
    create_database,
    create_table,
    replace_partitions,
    stored_bytes,
    stored_files,
    swap_in,
)

#: A day's files are put together up to this size.
FILE_BYTES = 256 * MB
CLUSTERED = "events_by_transaction"
BITMAPS = "transaction_bitmaps"


def small_days(lake: Lake, file_bytes: int = FILE_BYTES) -> list[str]:
    """Days of silver with at least two files under half the size; one short text a day."""
    small = stored_files(lake, "payments_events").where(
        (F.col("bytes") < file_bytes / 2) & F.col(EVENT_DAY.name).isNotNull()
    )
    days = small.groupBy(EVENT_DAY.name).count().where("count > 1").collect()
    return sorted(row[EVENT_DAY.name] for row in days)


def _bins(files: DataFrame, file_bytes: int) -> DataFrame:
    """Files of a day packed into bins of about ``file_bytes``, large ones first."""
    upto = F.sum("bytes").over(
        Window.partitionBy(EVENT_DAY.name).orderBy(F.desc("bytes"), "path")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    nth = F.floor((upto - F.col("bytes") / 2) / file_bytes).cast("int")
    return files.select("path", nth.alias("bin"))


def compact_silver(lake: Lake, file_bytes: int = FILE_BYTES) -> list[str]:
    """Put together the small files of the days that have them, and tell which days.

    Bins are packed from the listing. Only these days are read and written; all others
    keep their files. Rows of events without a time, in no day, are left as they are.
    """
    days = small_days(lake, file_bytes)
    if not days:
        return days
    own = F.col(EVENT_DAY.name).isin(days)
    bins = _bins(stored_files(lake, "payments_events", own), file_bytes)
    rows = lake.table("payments_events").where(own).select(
        *SILVER_STORED.fieldNames(), F.col("_metadata.file_path").alias("path")
    )
    packed = rows.join(bins, "path").repartition(EVENT_DAY.name, "bin")
    replace_partitions(
        lake, "payments_events", packed.select(*SILVER_STORED.fieldNames()), EVENT_DAY.name, days
    )
    return days


def cluster_events(lake: Lake, buckets: int | None = None) -> None:
    """Silver once more, in buckets of transactions, sorted within.

    It is shuffled once, here. Whatever is by transaction after that (ranking, distinct
    counts, ties) is done bucket by bucket without a shuffle.
    """
    create_database(lake)
    size = stored_bytes(lake, "payments_events")
    least = int(lake.spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or reducers(size * SHUFFLED_PER_STORED * PARQUET_DENSE, least)
    building = f"{CLUSTERED}__building"
    lake.spark.sql(f"DROP TABLE IF EXISTS {lake.name(building)}")
    with sized_for_stored(lake.spark, size):
        (
            lake.table("payments_events").select(*EVENT.fieldNames())
            .repartition(buckets, "transaction_id")
            .write.format("parquet").option("compression", "snappy")
            .option("path", f"{lake.root}/silver/by_transaction/{uuid.uuid4().hex}")
            .bucketBy(buckets, "transaction_id").sortBy("transaction_id")
            .saveAsTable(lake.name(building))
        )
    swap_in(lake, CLUSTERED)


def note_bitmaps(lake: Lake, days: list[str] | None = None) -> None:
    """Bitmaps of the transactions of days of silver, of all of them without ``days``.

    A day that is noted again is replaced; only the given days are read.
    """
    events = lake.table("payments_events").where(F.col(EVENT_DAY.name).isNotNull())
    if days is None:
        days = [r[0] for r in events.select(EVENT_DAY.name).distinct().orderBy("dt").collect()]
    spec = TableSpec(day_bitmaps(events).select(*_bitmap_columns()).schema, "gold/bitmaps", ("dt",))
    create_database(lake)
    create_table(lake, BITMAPS, f"{lake.root}/{spec.folder}", spec)
    own = events.where(F.col(EVENT_DAY.name).isin(days))
    rows = day_bitmaps(own).select(*_bitmap_columns()).repartition(EVENT_DAY.name)
    replace_partitions(lake, BITMAPS, rows, EVENT_DAY.name, days)


def _bitmap_columns() -> list[Column]:
    return [F.col(name) for name in ("part", "other", "n_events", "ids", EVENT_DAY.name)]
