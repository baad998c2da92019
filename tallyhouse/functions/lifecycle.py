"""The payment lifecycle and the order in which events supersede each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.schemas import EVENT, FACT_COLUMNS

# The lifecycle position of each event type. A transaction either
# settles or fails, so these two share a position.
LIFECYCLE_RANK = {
    "created": 0,
    "authorized": 1,
    "settled": 2,
    "failed": 2,
    "refunded": 3,
}


_DECIDED_FIRST = {"transaction_id", "event_timestamp", "event_type"}
TIEBREAKS = [
    c
    for c in dict.fromkeys(["amount", "merchant_id", *FACT_COLUMNS, *EVENT.fieldNames()])
    if c not in _DECIDED_FIRST
]


def lifecycle_rank(event_type: Column) -> Column:
    """Position in the lifecycle; null for a type outside it."""
    expression = F.lit(None).cast("int")
    for name, rank in LIFECYCLE_RANK.items():
        expression = F.when(event_type == name, rank).otherwise(expression)
    return expression


def precedence(columns: list[str]) -> list[Column]:
    """What decides which of two events of a transaction is newer, in order.

    Time decides, then the lifecycle, then the event type. Nulls are lowest, so
    an event without a time loses, and so does one of an unknown type at the
    same time. All other columns follow so that the order is total and a retried
    task picks the same row again; they are compared only for events that tie on
    everything before. Those a fact needs come first: a query that reads fewer
    columns then ranks events as one that reads them all.
    """
    tiebreaks = [c for c in TIEBREAKS if c in columns]
    return [
        F.col("event_timestamp"),
        lifecycle_rank(F.col("event_type")).alias("lifecycle_rank"),
        F.col("event_type"),
        *[F.col(c) for c in tiebreaks],
    ]


def newest_first(columns: list[str]) -> list[Column]:
    """``precedence`` as descending sort keys, nulls last."""
    return [key.desc_nulls_last() for key in precedence(columns)]
