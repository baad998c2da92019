"""Exact distinct transactions that add up over days.

Distinct counts of single days cannot be added, bitmaps of them can. An id that is a number
under its prefix sets one bit; bits lie in bitmaps of fixed size, one for each day and range
of numbers. Any set of days is counted by or-ing its bitmaps, without the events, and a new
day needs only its own. Ids of another form are kept as they are, distinct by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One text for each number: padded to twelve digits, or longer without leading zeros.
_NUMBERED = r"^txn_([0-9]{12}|[1-9][0-9]{12,17})$"


def _number(transaction_id: Column) -> Column:
    return F.when(
        transaction_id.rlike(_NUMBERED), F.substring(transaction_id, 5, 18).cast("long")
    )


def day_bitmaps(events: DataFrame) -> DataFrame:
    """Per day and range of numbers the events and a bitmap of the ids (dt, part, other).

    ``other`` is an id of another form, with no bitmap; a null id counts as events alone.
    """
    number = _number(F.col("transaction_id"))
    keyed = events.select(
        "dt", number.alias("number"),
        F.when(number.isNull(), F.col("transaction_id")).alias("other"),
    )
    return keyed.groupBy("dt", F.bitmap_bucket_number("number").alias("part"), "other").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("ids"),
    )


def distinct_from_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """Events and exact distinct transactions over the days of ``bitmaps``."""
    merged = bitmaps.groupBy("part", "other").agg(
        F.sum("n_events").alias("n_events"), F.bitmap_or_agg("ids").alias("ids")
    )
    ids = F.when(F.col("part").isNotNull(), F.bitmap_count("ids")).otherwise(
        F.col("other").isNotNull().cast("long")
    )
    return merged.agg(
        F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"),
        F.coalesce(F.sum(ids), F.lit(0)).alias("n_transactions"),
    )
