"""The given tables and the event log derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.operators import derive_events

# The columns that are read, declared so that no file is opened to infer them.
GIVEN = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string",
    "supplier": "s_suppkey bigint, s_name string",
    "lineitem": "l_orderkey bigint, l_shipdate timestamp_ntz, l_returnflag string",
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(GIVEN[name]).parquet(f"{sf_dir}/{name}.parquet")


def _roster(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [given(spark, sf_dir, name) for name in GIVEN]


def bronze_events(spark: SparkSession, sf_dir: str, created: str = "window") -> DataFrame:
    return derive_events.bronze_events(*_roster(spark, sf_dir), created)


def payment_events(spark: SparkSession, sf_dir: str, created: str = "window") -> DataFrame:
    return derive_events.payment_events(*_roster(spark, sf_dir), created)


def merchants_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, supplier, _ = _roster(spark, sf_dir)
    return derive_events.flat_roster(orders, customer, supplier, "merchant")


def customers_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, supplier, _ = _roster(spark, sf_dir)
    return derive_events.flat_roster(orders, customer, supplier, "customer")
