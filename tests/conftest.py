from __future__ import annotations

import json
import sys
import uuid
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyhouse.schemas import BRONZE_STORED  # noqa: E402
from tallyhouse.session import build_session  # noqa: E402
from tallyhouse.sources.catalog import Lake  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session settings for one test."""
    before = {}

    def set_conf(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield set_conf
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def lake(spark, tmp_path):
    name = f"test_{uuid.uuid4().hex[:10]}"
    yield Lake(spark, str(tmp_path / "lake"), name)
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")


def event(transaction="t1", kind="settled", at="2026-08-06T10:00:00Z", **other):
    """A bronze event; nested objects take keyword overrides as dicts."""
    method = {"type": "card", "brand": "visa", "last4": "0042", "token": "tok_1"}
    return {
        "transaction_id": transaction,
        "event_type": kind,
        "event_timestamp": at,
        "amount": other.pop("amount", 10.5),
        "currency": other.pop("currency", "USD"),
        "merchant": {"merchant_id": "m1", "name": "Shop", "category": "retail"}
        | other.pop("merchant", {}),
        "customer": {"customer_id": "c1", "name": "Ann Lee", "email": "a@example.com"}
        | other.pop("customer", {}),
        "payment_method": other.pop("payment_method", method),
        **other,
    }


def write_text(path, text):
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def write_bronze(lake, events, name=None):
    """Events as JSON lines in the folder of the day each one occurred."""
    days = {}
    for each in events:
        days.setdefault((each["event_timestamp"] or "2026-01-01")[:10], []).append(each)
    for day, rows in days.items():
        text = "\n".join(json.dumps(row) for row in rows)
        write_text(f"{lake.bronze}/dt={day}/{name or uuid.uuid4().hex}.json", text)


def bronze_frame(spark, events):
    rows = [json.dumps(each) for each in events]
    lines = spark.createDataFrame([(row,) for row in rows], "value string")
    from pyspark.sql import functions as F

    parsed = F.from_json("value", BRONZE_STORED, {"mode": "FAILFAST"})
    return lines.select(parsed.alias("e")).select("e.*")


def rows_of(frame):
    """Rows as a sorted list, so that frames compare by content."""
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def plan_of(frame):
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
