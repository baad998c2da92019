"""The latest event of each transaction.

Both plans reduce every map task to one row per transaction before the shuffle,
so a transaction that holds a large share of all events sends one row per task
to its reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import TIEBREAKS, newest_first, precedence
from tallyhouse.schemas import BUCKET, EVENT, FACT_COLUMNS


def _event_columns(events: DataFrame) -> DataFrame:
    return events.select(*[c for c in EVENT.fieldNames() if c in events.columns])


def current_state(events: DataFrame) -> DataFrame:
    """One event per ``transaction_id``; a null id is a transaction too.

    Spark plans the filter on the row number as a window group limit on either
    side of the shuffle. The result has the event columns ``events`` has.
    """
    events = _event_columns(events)
    by_transaction = Window.partitionBy("transaction_id").orderBy(*newest_first(events.columns))
    return (
        events.withColumn("recency", F.row_number().over(by_transaction))
        .where("recency = 1")
        .drop("recency")
    )


def in_buckets(current: DataFrame, buckets: int) -> DataFrame:
    """Rows with the bucket their transaction falls in; a null id has one too."""
    hashed = F.xxhash64("transaction_id")
    return current.withColumn(BUCKET.name, F.pmod(hashed, F.lit(buckets)).cast("int"))


def merged_state(current: DataFrame, arrived: DataFrame, buckets: int) -> DataFrame:
    """The latest of what was current and what arrived, by bucket.

    ``arrived`` is reduced to one event per transaction first, where its tasks reduce their
    own part; then both are dealt by bucket, so that a bucket is ranked and written by one
    task and the rows of ``current`` are shuffled once.
    """
    both = in_buckets(current_state(arrived), buckets).unionByName(
        current.select(*[c for c in current.columns if c in {*EVENT.fieldNames(), BUCKET.name}])
    )
    by_transaction = Window.partitionBy(BUCKET.name, "transaction_id").orderBy(
        *newest_first(EVENT.fieldNames())
    )
    return (
        both.repartition(BUCKET.name)
        .withColumn("recency", F.row_number().over(by_transaction))
        .where("recency = 1")
        .drop("recency")
    )


def current_state_by_max(events: DataFrame) -> DataFrame:
    """The same rows from a partial and final maximum over the ordered columns."""
    events = _event_columns(events)
    latest = events.groupBy("transaction_id").agg(
        F.max(F.struct(*precedence(events.columns))).alias("latest")
    )
    others = [c for c in events.columns if c != "transaction_id"]
    return latest.select("transaction_id", *[F.col(f"latest.{c}").alias(c) for c in others])


def fact(current: DataFrame) -> DataFrame:
    """Current state with the descriptive columns left to the dimensions."""
    return current.select(*[F.col(name).alias(alias) for name, alias in FACT_COLUMNS.items()])


def fct_transactions(events: DataFrame) -> DataFrame:
    return fact(current_state(events.select(*FACT_COLUMNS)))


def narrow_fact(events: DataFrame, *measures: str) -> DataFrame:
    """The fact's key, status and time with the first few of the other columns.

    For a query that goes straight from the event log: columns it does not ask
    for are neither read nor shuffled. ``measures`` are leading tiebreaks, so
    that the same events win as in the full fact.
    """
    if list(measures) != TIEBREAKS[: len(measures)]:
        raise ValueError(f"measures must lead {TIEBREAKS}, not {measures}")
    columns = ["transaction_id", "event_type", "event_timestamp", *measures]
    current = current_state(events.select(*columns))
    return current.select(*[F.col(c).alias(FACT_COLUMNS[c]) for c in columns])
