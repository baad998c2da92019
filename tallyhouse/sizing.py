"""Scan splits and shuffle partitions sized from the bytes a job reads."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import SparkSession

MB = 1 << 20
SPLIT_BYTES = (128 * MB, 1024 * MB)
MAX_SCAN_TASKS = 200_000
REDUCER_BYTES = 512 * MB
MAX_REDUCERS = 50_000

# Bytes that ranking shuffles for each byte it scans, as measured: silver is
# compressed by columns and the rows of a shuffle are not.
SHUFFLED_PER_STORED = 4.5

# How much smaller splits and reducers are for inputs that are dense, so that a task that
# sorts what it reads does so in memory: silver takes up to 13 times its bytes as rows,
# and bronze JSON is a sixteenth to an eighteenth of its text under gzip, as measured.
PARQUET_DENSE = 4
GZIP_DENSE = 16

# Partitions of a shuffle by day. A day is one key, so more of them stay empty;
# AQE splits the large ones at the advisory size.
DAY_PARTITIONS = 1_000

_SPLITS = "spark.sql.files.maxPartitionBytes"
_REDUCERS = "spark.sql.shuffle.partitions"


def split_bytes(input_bytes: int) -> int:
    """128 MB, growing to 1 GB so that the number of map tasks stays bounded."""
    smallest, largest = SPLIT_BYTES
    return min(max(math.ceil(input_bytes / MAX_SCAN_TASKS), smallest), largest)


def reducers(shuffled_bytes: float, at_least: int) -> int:
    """One reducer per 512 MB shuffled; AQE merges those that turn out small.

    The bound keeps map tasks times reducers, the number of shuffle blocks, in
    reach. Beyond it reducers get larger and sort through disk.
    """
    return max(at_least, min(math.ceil(shuffled_bytes / REDUCER_BYTES), MAX_REDUCERS))


def day_partitions(spark: SparkSession) -> int:
    return min(int(spark.conf.get(_REDUCERS)), DAY_PARTITIONS)


@contextmanager
def sized_for(
    spark: SparkSession, scanned_bytes: int, shuffled_bytes: float | None = None, dense: int = 1
) -> Iterator[None]:
    """Run a job with splits fit to what it scans and reducers to what it shuffles.

    Reducers are never fewer than the session's; without a figure for the shuffle
    it is taken to be as large as the scan. ``dense`` inputs get smaller splits and more
    reducers.
    """
    before = {key: spark.conf.get(key) for key in (_SPLITS, _REDUCERS)}
    shuffled = scanned_bytes if shuffled_bytes is None else shuffled_bytes
    spark.conf.set(_SPLITS, str(split_bytes(scanned_bytes) // dense))
    spark.conf.set(_REDUCERS, str(reducers(shuffled * dense, int(before[_REDUCERS]))))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def sized_for_stored(spark: SparkSession, stored: int) -> AbstractContextManager[None]:
    """The same for a job that shuffles or sorts ``stored`` bytes of Parquet."""
    return sized_for(spark, stored, stored * SHUFFLED_PER_STORED, PARQUET_DENSE)
