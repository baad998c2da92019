"""Payment events derived from the order, line, customer and supplier tables.

Every order becomes one transaction: its customer pays and a supplier is the
merchant. What happened to it and when is what the order and its lines record:
it is created and authorized on the order's day, fails if there are no lines,
settles when the first line ships, and is refunded when the last one has shipped
if all of them came back. Lines are reduced to one row per order before they are
joined, and the roster is joined before the lifecycle multiplies transactions
into events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import (
    clamp,
    iso_utc,
    padded_id,
    pick,
    short_token,
)
from tallyhouse.schemas import BRONZE_EVENT, FLAT_COLUMNS

# Fixed values of the data model.
MERCHANT_CATEGORIES = [
    "retail", "grocery", "travel", "electronics", "dining", "subscription", "fuel", "utilities",
]
CARD_BRANDS = ["visa", "mastercard", "amex"]
CURRENCIES = ["USD", "USD", "USD", "EUR", "GBP"]
# 70 % cards, 20 % transfers, 10 % wallets: labels of the input, by key, since the
# given tables record no payment method.
PAYMENT_METHODS = ["card"] * 7 + ["bank_transfer"] * 2 + ["wallet"]
EMAIL_DOMAIN = "@example.com"

# Nothing is reported after this moment; later shipments count as of it.
AS_OF = "2001-08-01 00:00:00"
RETURNED = "R"
WEEK = 7


def merchants(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        key,
        F.struct(
            padded_id("mrc_", key, 4).alias("merchant_id"),
            F.col("s_name").alias("name"),
            pick(MERCHANT_CATEGORIES, key).alias("category"),
        ).alias("merchant"),
    )


def customers(customer: DataFrame) -> DataFrame:
    name = F.col("c_name")
    mailbox = F.lower(F.replace(name, F.lit("#"), F.lit(".")))
    return customer.select(
        F.col("c_custkey"),
        F.struct(
            padded_id("cus_", F.col("c_custkey"), 6).alias("customer_id"),
            name.alias("name"),
            F.concat(mailbox, F.lit(EMAIL_DOMAIN)).alias("email"),
        ).alias("customer"),
    )


def payment_method(key: Column) -> Column:
    kind = pick(PAYMENT_METHODS, key)
    is_card = kind == "card"
    return F.struct(
        kind.alias("type"),
        F.when(is_card, pick(CARD_BRANDS, key)).alias("brand"),
        F.when(is_card, padded_id("", key % 10000, 4)).alias("last4"),
        short_token(key).alias("token"),
    )


def shipments(lineitem: DataFrame) -> DataFrame:
    """One row per order that has lines: its first and last shipping, and if all came back."""
    returned = F.coalesce(F.col("l_returnflag") == RETURNED, F.lit(False))
    return lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(
        F.lit(True).alias("has_lines"),
        F.min("l_shipdate").alias("first_shipped"),
        F.max("l_shipdate").alias("last_shipped"),
        F.bool_and(returned).alias("all_returned"),
    )


def transactions(
    orders: DataFrame,
    customer: DataFrame,
    supplier: DataFrame,
    lineitem: DataFrame,
    created: str = "window",
) -> DataFrame:
    """One row per order with its merchant, customer, payment method and shipments.

    ``created`` is ``history``, times as recorded, or ``window``: every order and
    its shipments moved forward by whole weeks so that it is placed in the week
    before ``AS_OF``, where many events are clamped and tie. Shipments, which are
    already dealt by order, meet the few columns of orders in a sort-merge join, which waits
    for no side to be collected; all else is attached after.
    """
    age = F.datediff(F.lit(AS_OF).cast("timestamp_ntz"), F.col("ordered_at"))
    weeks = {"window": F.floor(age / WEEK), "history": F.lit(0)}[created]
    shipped = placed_orders(orders).join(shipments(lineitem).hint("merge"), "key", "left")
    return with_roster(shipped, customer, supplier).withColumn(
        "moved", F.make_dt_interval(days=(weeks * WEEK).cast("int"))
    )


def placed_orders(orders: DataFrame) -> DataFrame:
    """The columns of orders that a transaction needs, under its own names."""
    return orders.select(
        F.col("o_orderkey").alias("key"),
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("ordered_at"),
    )


def with_roster(placed: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Placed orders with customer, merchant and what follows from the order's key."""
    key = F.col("key")
    supplier_count = supplier.select(F.count(F.lit(1))).scalar()
    return (
        placed.withColumn("s_suppkey", key % supplier_count)
        .join(customers(customer), "c_custkey")
        .join(merchants(supplier), "s_suppkey")
        .withColumns({
            "transaction_id": padded_id("txn_", key, 12),
            "currency": pick(CURRENCIES, key),
            "payment_method": payment_method(key),
        })
    )


def lifecycle() -> Column:
    """The events of a transaction as an array of (type, when it happened)."""
    shipped = F.col("has_lines").isNotNull()
    refunds = shipped & F.col("all_returned")
    ordered = F.col("ordered_at")

    def step(event_type: str, at: Column) -> Column:
        return F.struct(F.lit(event_type).alias("type"), (at + F.col("moved")).alias("at"))

    return F.array(
        step("created", ordered),
        step("authorized", ordered),
        F.when(shipped, step("settled", F.greatest(ordered, F.col("first_shipped"))))
        .otherwise(step("failed", ordered)),
        F.when(refunds, step("refunded", F.greatest(ordered, F.col("last_shipped")))),
    )


def _events(paid: DataFrame) -> DataFrame:
    """One row per event, with its type and time."""
    steps = paid.withColumn("step", F.explode(lifecycle())).where("step is not null")
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return steps.withColumn("event_type", F.col("step.type")).withColumn(
        "happened_at", clamp(F.col("step.at"), as_of)
    )


def bronze_events(
    orders: DataFrame,
    customer: DataFrame,
    supplier: DataFrame,
    lineitem: DataFrame,
    created: str = "window",
) -> DataFrame:
    """The event log as it lands in bronze: nested, with ISO-8601 times."""
    events = _events(transactions(orders, customer, supplier, lineitem, created))
    stamped = events.withColumn("event_timestamp", iso_utc(F.col("happened_at")))
    return stamped.select(*BRONZE_EVENT.fieldNames())


def payment_events(
    orders: DataFrame,
    customer: DataFrame,
    supplier: DataFrame,
    lineitem: DataFrame,
    created: str = "window",
) -> DataFrame:
    """The same log in silver's shape, without the way through stored JSON."""
    events = _events(transactions(orders, customer, supplier, lineitem, created))
    stamped = events.withColumnRenamed("happened_at", "event_timestamp")
    return stamped.select(*[F.col(c.path).alias(c.name) for c in FLAT_COLUMNS])


def flat_roster(
    orders: DataFrame, customer: DataFrame, supplier: DataFrame, part: str
) -> DataFrame:
    """The ``merchant`` or ``customer`` columns of every transaction.

    Every order has events, so these are those of the log, without its lines and before
    a transaction is multiplied into events.
    """
    paid = with_roster(placed_orders(orders), customer, supplier)
    return paid.select(
        *[F.col(c.path).alias(c.name) for c in FLAT_COLUMNS if c.path.startswith(f"{part}.")]
    )
