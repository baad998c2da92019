"""Settled revenue by merchant, over the fact and its merchant dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Doubles added in another order give another sum, and every retry is another
# order. Amounts are added as decimals, exactly, to a millionth. What a decimal
# can't hold (NaN, infinity, beyond 10^22, digits past a millionth) is added beside
# it as doubles; for ordinary amounts that is an exact zero.
EXACT = "decimal(28,6)"


def _parts(amount: Column) -> tuple[Column, Column]:
    """An amount as a decimal and the double that is missing from it; null stays null."""
    exact = amount.try_cast(EXACT)
    return exact, F.when(exact.isNull(), amount).otherwise(amount - exact.cast("double"))


def _total(exact: Column, rest: Column) -> Column:
    """Both sums together, to two places; null only where no amount was there."""
    whole = F.coalesce(exact.cast("double"), F.lit(0.0)) + rest
    return F.when(rest == 0, F.round(exact, 2).cast("double")).otherwise(F.round(whole, 2))


def settled_revenue_by_merchant(fact: DataFrame, merchants: DataFrame) -> DataFrame:
    """Settled transactions and amount per merchant name and category.

    "Settled" is the current status, so a refunded transaction no longer counts.
    Currencies are summed as they are, and merchants of one name and category
    share a row.

    The fact is reduced to one row per merchant before the join, which then has
    merchants on both sides however many transactions one of them has. A
    merchant with two dimension rows contributes to both, as it would if the
    transactions themselves were joined.
    """
    exact, rest = _parts(F.col("amount"))
    settled = (
        fact.where(F.col("status") == "settled")
        .groupBy("merchant_id")
        .agg(
            F.count(F.lit(1)).alias("settled"),
            F.sum(exact).alias("exact"),
            F.sum(rest).alias("rest"),
        )
    )
    return (
        settled.join(merchants, "merchant_id")
        .groupBy("merchant_name", "merchant_category")
        .agg(
            F.sum("settled").alias("settled_transactions"),
            _total(F.sum("exact"), F.sum("rest")).alias("total_settled_amount"),
        )
        .orderBy(F.desc("total_settled_amount"))
    )
