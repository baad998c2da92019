"""One key may hold a third of all rows."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyhouse import sizing
from tallyhouse.operators import current_state, derive_events, revenue
from tallyhouse.schemas import BRONZE_EVENT, EVENT
from tallyhouse.sources import tables
from tallyhouse.sources.bronze import land_bronze
from tests.conftest import SF, plan_of, rows_of

ROWS, TASKS = 900, 6
DAY_ROWS = 60_000


def shuffled_rows(frame):
    """Rows written by each shuffle of a finished query; plans print three digits."""
    frame.collect()
    final = plan_of(frame).split("Initial Plan")[0]
    return [int(n) for n in re.findall(r"ShuffleQueryStage.*rowCount=(\d+)", final)]


@pytest.fixture
def hot_events(spark):
    """A third of the events belong to one transaction of one merchant."""
    hot = F.col("id") % 3 == 0
    known = {
        "transaction_id": F.when(hot, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))),
        "event_type": F.lit("settled"),
        "event_timestamp": F.timestamp_seconds(F.col("id")).cast("timestamp_ntz"),
        "amount": F.lit(1.0),
        "merchant_id": F.when(hot, "m_hot").otherwise(F.concat(F.lit("m"), F.col("id") % 50)),
    }
    columns = [
        known.get(f.name, F.lit("x")).cast(f.dataType).alias(f.name) for f in EVENT.fields
    ]
    return spark.range(0, ROWS, 1, TASKS).select(*columns)


@pytest.mark.parametrize("plan", [current_state.current_state, current_state.current_state_by_max])
def test_hot_transaction_sends_one_row_per_task(hot_events, plan):
    result = plan(hot_events)
    (shuffled,) = shuffled_rows(result)
    assert shuffled == ROWS * 2 // 3 + TASKS
    assert result.count() == ROWS * 2 // 3 + 1
    newest = result.where("transaction_id = 'hot'").first()["event_timestamp"]
    assert str(newest) == "1970-01-01 00:14:57"


def test_hot_merchant_is_aggregated_before_the_shuffle(spark, hot_events):
    fact = current_state.fact(hot_events)
    merchants = hot_events.select("merchant_id").distinct().select(
        "merchant_id", F.col("merchant_id").alias("merchant_name"), F.lit("c").alias("merchant_category")
    )
    result = revenue.settled_revenue_by_merchant(fact, merchants)
    assert max(shuffled_rows(result)) <= 51 * TASKS
    top = result.first()
    assert (top["merchant_name"], top["settled_transactions"]) == ("m_hot", ROWS // 3)


def test_hot_day_is_split_and_small_days_are_not(spark, conf, lake, monkeypatch):
    monkeypatch.setattr(sizing, "DAY_PARTITIONS", 2000)
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "40k")
    conf("spark.sql.shuffle.partitions", "2000")
    day = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 30)
    at = F.timestamp_seconds(day * 86400 + F.col("id") % 86400)
    known = {
        "transaction_id": F.uuid(),
        "event_timestamp": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    }
    events = spark.range(0, DAY_ROWS, 1, TASKS).select(
        *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in BRONZE_EVENT.fields]
    )
    land_bronze(events, lake.bronze)
    files = {d.name: len(list(d.glob("*.json"))) for d in Path(lake.bronze).glob("dt=*")}
    assert len(files) == 21
    assert files.pop("dt=1970-01-01") >= TASKS
    assert max(files.values()) <= 3


def test_hot_customer_is_split_when_nothing_is_broadcast(spark, conf):
    orders = tables.given(spark, "/root/testdata/sf0.01", "orders")
    customer = tables.given(spark, "/root/testdata/sf0.01", "customer")
    supplier = tables.given(spark, "/root/testdata/sf0.01", "supplier")
    lines = tables.given(spark, "/root/testdata/sf0.01", "lineitem")
    skewed = orders.withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(F.col("o_custkey"))
    ).repartition(8, "o_orderkey")
    wanted = rows_of(
        derive_events.payment_events(skewed, customer, supplier, lines).groupBy("customer_id").count()
    )
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "4k")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    joined = derive_events.transactions(skewed, customer, supplier, lines)
    joined.collect()
    final = plan_of(joined).split("Initial Plan")[0]
    assert "SortMergeJoin" in final and "Broadcast" not in final
    assert "SortMergeJoin(skew=true)" in final
    events = derive_events.payment_events(skewed, customer, supplier, lines)
    assert rows_of(events.groupBy("customer_id").count()) == wanted


def test_same_answer_without_broadcasts(spark, conf):
    from tallyhouse import queries

    broadcast = [tuple(r) for r in queries.settled_revenue_by_merchant(spark, SF).collect()]
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    shuffled = queries.settled_revenue_by_merchant(spark, SF)
    assert [tuple(r) for r in shuffled.collect()] == broadcast
    assert "Broadcast" not in plan_of(shuffled)
