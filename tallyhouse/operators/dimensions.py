"""Merchant and customer dimensions.

Each is the plain set of distinct tuples: an id that was seen under two names
has two rows. Partial aggregation leaves only distinct tuples to shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyhouse.schemas import CUSTOMER_COLUMNS, MERCHANT_COLUMNS


def dim_merchants(events: DataFrame) -> DataFrame:
    return events.select(*MERCHANT_COLUMNS).distinct()


def dim_customers(events: DataFrame) -> DataFrame:
    return events.select(*CUSTOMER_COLUMNS).distinct()
