"""Counts over the event log and the current state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def events_per_day(events: DataFrame) -> DataFrame:
    return events.groupBy("dt").agg(F.count(F.lit(1)).alias("n_events"))


def event_days(events: DataFrame) -> DataFrame:
    """The days that have events, in order."""
    return events.select("dt").distinct().orderBy("dt")


def status_distribution(fact: DataFrame) -> DataFrame:
    return fact.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def distinct_transactions(events: DataFrame) -> DataFrame:
    """Events and exact distinct transactions; a null id is not counted.

    Counted in two steps, so that the ids are spread over the cluster and only
    one row per task meets in the end.
    """
    per_transaction = events.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("events"))
    return per_transaction.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("n_events"),
        F.count("transaction_id").alias("n_transactions"),
    )


def tied_transactions(events: DataFrame) -> DataFrame:
    """Transactions with several events at one time, which time cannot order."""
    return (
        events.groupBy("transaction_id", "event_timestamp")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
