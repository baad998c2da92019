"""Checks on the stored layers, as counts of violations and of lag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import LIFECYCLE_RANK



def _rules(counts: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row of counters turned into one row per rule."""
    wide = counts.select(*[value.cast("bigint").alias(name) for name, value in rules.items()])
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules]
    return wide.select(F.inline(F.array(*pairs)))


def row_rules(table: str, rows: DataFrame, key: str, broken: dict[str, Column]) -> DataFrame:
    """Rules on single rows and uniqueness of their key, from one pass and one shuffle.

    Each column of ``broken`` is true where its rule is. Counters per key meet the
    shuffle, not rows.
    """
    names = [f"{table}: {rule}" for rule in broken]
    per_key = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(condition).alias(name) for name, condition in zip(names, broken.values(), strict=True)],
    )
    sums = {name: F.coalesce(F.sum(F.col(f"`{name}`")), F.lit(0)) for name in names}
    sums[f"{table}: {key} is unique"] = F.count_if(F.col("n") > 1)
    counted = per_key.agg(*[total.alias(name) for name, total in sums.items()])
    return _rules(counted, {name: F.col(f"`{name}`") for name in sums})


def unique(table: str, rows: DataFrame, key: str) -> DataFrame:
    """Keys with more than one row; partial counts meet the shuffle, not rows."""
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    counted = repeated.agg(F.count_if(F.col("n") > 1).alias("n"))
    return _rules(counted, {f"{table}: {key} is unique": F.col("n")})


def resolves(table: str, rows: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Distinct foreign keys without a dimension row, for all keys in one pass over ``rows``.

    ``dimensions`` has a table with a column of the same name for each key column.
    """
    pairs = [
        F.struct(F.lit(key).alias("key"), F.col(key).cast("string").alias("value"))
        for key in dimensions
    ]
    used = rows.select(F.inline(F.array(*pairs))).where("value is not null").distinct()
    there = reduce(DataFrame.unionByName, [
        dimension.select(F.lit(key).alias("key"), F.col(key).cast("string").alias("value"))
        for key, dimension in dimensions.items()
    ])
    dangling = used.join(there, ["key", "value"], "left_anti")
    counted = dangling.agg(*[F.count_if(F.col("key") == key).alias(key) for key in dimensions])
    return _rules(counted, {f"{table}: {key} resolves": F.col(key) for key in dimensions})


def quality_violations(fact: DataFrame, merchants: DataFrame, customers: DataFrame) -> DataFrame:
    """Every rule on the star schema with its number of violations: two passes over the fact."""
    required = ["transaction_id", "last_event_at", "amount", "merchant_id", "customer_id"]
    broken = {f"{column} is present": F.col(column).isNull() for column in required}
    known = F.coalesce(F.col("status").isin(*LIFECYCLE_RANK), F.lit(False))
    broken["status is known"] = ~known
    checks = [
        row_rules("fct_transactions", fact, "transaction_id", broken),
        unique("dim_merchants", merchants, "merchant_id"),
        unique("dim_customers", customers, "customer_id"),
        resolves("fct_transactions", fact, {"merchant_id": merchants, "customer_id": customers}),
    ]
    return reduce(DataFrame.unionByName, checks)


def days_behind(upstream_days: DataFrame, downstream_days: DataFrame) -> DataFrame:
    """Days the layer before has and this one lacks."""
    return upstream_days.join(downstream_days, "dt", "left_anti").orderBy("dt")


def newest_event(layer: str, event_time: Column, rows: DataFrame) -> DataFrame:
    return rows.agg(F.max(event_time).alias("newest_event")).select(
        F.lit(layer).alias("layer"), "newest_event"
    )


class QualityError(ValueError):
    """Stored data breaks a rule."""


def require_quality(violations: DataFrame) -> None:
    """Raise if any rule is broken; there is one row per rule to look at."""
    broken = violations.where("violations > 0").orderBy("rule").collect()
    if broken:
        raise QualityError("; ".join(f"{row['rule']}: {row['violations']}" for row in broken))
