"""Hand-written events for the cases where the semantics are easy to get wrong."""

import datetime
import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from tallyhouse.operators.current_state import (
    current_state,
    current_state_by_max,
    fct_transactions,
    narrow_fact,
)
from tallyhouse.operators.dimensions import dim_merchants
from tallyhouse.operators.flatten import flatten
from tallyhouse.operators.revenue import settled_revenue_by_merchant
from tallyhouse.plans import jobs
from tallyhouse.schemas import EVENT, SILVER_STORED, types_of
from tallyhouse.sources.bronze import read_bronze
from tests.conftest import bronze_frame, event, rows_of, write_bronze, write_text

AT = "2026-08-06T10:00:00Z"
LATER = "2026-08-06T11:00:00Z"


def status(spark, *events):
    """The winning event type under both plans, and in the narrow fact."""
    flat = flatten(bronze_frame(spark, events))
    by_window = current_state(flat).select("event_type").collect()
    by_max = current_state_by_max(flat).select("event_type").collect()
    narrow = narrow_fact(flat).select("status").collect()
    assert len(by_window) == 1
    assert [tuple(r) for r in by_window] == [tuple(r) for r in by_max] == [tuple(r) for r in narrow]
    return by_window[0][0]


def test_later_event_wins_whatever_its_rank(spark):
    assert status(spark, event(kind="refunded", at=AT), event(kind="created", at=LATER)) == "created"


def test_clamped_tie_goes_to_the_refund(spark):
    assert status(spark, event(kind="settled"), event(kind="refunded")) == "refunded"
    assert status(spark, event(kind="refunded"), event(kind="settled")) == "refunded"


def test_unknown_type_loses_a_tie(spark):
    assert status(spark, event(kind="chargeback"), event(kind="refunded")) == "refunded"
    assert status(spark, event(kind="chargeback"), event(kind="created")) == "created"


def test_null_time_loses(spark):
    assert status(spark, event(kind="settled"), event(kind="created", at=None)) == "settled"


def test_same_rank_tie_is_decided_by_type(spark):
    assert status(spark, event(kind="settled"), event(kind="failed")) == "settled"
    assert status(spark, event(kind="failed"), event(kind="settled")) == "settled"


def test_full_ties_do_not_depend_on_order(spark):
    events = [event(amount=float(i), currency="EUR" if i % 2 else "USD") for i in range(6)]
    picked = {
        tuple(current_state(flatten(bronze_frame(spark, order))).first())
        for order in (events, events[::-1], events[3:] + events[:3])
    }
    assert len(picked) == 1


def test_narrow_and_wide_fact_pick_the_same_event(spark):
    events = [
        event(amount=5.0, merchant={"merchant_id": f"m{i}"}, customer={"customer_id": f"c{9 - i}"})
        for i in range(9)
    ]
    flat = flatten(bronze_frame(spark, events))
    columns = ["transaction_id", "status", "last_event_at", "amount", "merchant_id"]
    assert rows_of(fct_transactions(flat).select(*columns)) == rows_of(
        narrow_fact(flat, "amount", "merchant_id").select(*columns)
    )


def test_narrow_fact_takes_leading_tiebreaks_only(spark):
    flat = flatten(bronze_frame(spark, [event()]))
    with pytest.raises(ValueError, match="lead"):
        narrow_fact(flat, "currency")


def test_null_transaction_is_one_group(spark):
    flat = flatten(
        bronze_frame(spark, [event(None, "created"), event(None, "settled"), event("t2")])
    )
    assert {r["transaction_id"] for r in current_state(flat).collect()} == {None, "t2"}
    assert rows_of(current_state(flat)) == rows_of(
        current_state_by_max(flat).select(*EVENT.fieldNames())
    )


def test_exact_duplicates_stay_in_silver_only(spark):
    flat = flatten(bronze_frame(spark, [event(), event()]))
    assert flat.count() == 2
    assert current_state(flat).count() == 1


def test_day_boundary(spark):
    flat = flatten(
        bronze_frame(
            spark,
            [event(at="2026-08-05T23:59:59Z"), event(at="2026-08-06T00:00:00Z")],
        )
    )
    assert [r["dt"] for r in flat.orderBy("dt").collect()] == ["2026-08-05", "2026-08-06"]


def test_offsets_are_honoured(spark):
    flat = flatten(bronze_frame(spark, [event(at="2026-08-06T01:00:00+02:00")])).first()
    assert flat["dt"] == "2026-08-05"
    assert flat["event_timestamp"] == datetime.datetime(2026, 8, 5, 23)


def test_other_session_zone_is_refused(spark, conf):
    conf("spark.sql.session.timeZone", "America/New_York")
    with pytest.raises(ValueError, match="UTC"):
        flatten(bronze_frame(spark, [event()]))


def test_optional_fields_and_unknown_fields(spark, lake):
    wallet = event(payment_method={"type": "wallet", "token": "tok_2"}, surprise={"a": 1})
    write_bronze(lake, [wallet])
    row = flatten(read_bronze(spark, lake.bronze)).first()
    assert row["payment_method_type"] == "wallet"
    assert row["payment_method_brand"] is None and row["payment_method_last4"] is None
    assert types_of(flatten(read_bronze(spark, lake.bronze)).schema) == types_of(SILVER_STORED)


def test_array_lines_and_pretty_arrays_are_the_same_events(spark, lake):
    events = [event(f"t{i}", at=f"2026-08-06T10:00:{i:02d}Z") for i in range(6)]
    forms = {
        "lines": ("\n".join(map(json.dumps, events)), False),
        "array": (json.dumps(events), False),
        "array_again": (json.dumps(events), True),
        "pretty": (json.dumps(events, indent=2), True),
    }
    found = []
    for name, (text, multi_line) in forms.items():
        folder = f"{lake.root}/{name}"
        write_text(f"{folder}/dt=2026-08-06/x.json", text)
        found.append(rows_of(flatten(read_bronze(spark, folder, multi_line))))
    assert len(found[0]) == 6
    assert all(each == found[0] for each in found)


def test_only_json_objects_are_read(spark, lake):
    write_bronze(lake, [event()])
    write_text(f"{lake.bronze}/dt=2026-08-06/notes.txt", "not an event")
    assert read_bronze(spark, lake.bronze).count() == 1


def test_empty_array_has_no_events(spark, lake):
    write_text(f"{lake.bronze}/dt=2026-08-06/x.json", "[]")
    assert read_bronze(spark, lake.bronze).count() == 0
    assert jobs.promote_silver(lake) is None


def test_no_bronze_leaves_silver_alone(spark, lake, tmp_path):
    write_bronze(lake, [event()])
    jobs.promote_silver(lake)
    before = rows_of(lake.table("payments_events"))
    (tmp_path / "lake/bronze").rename(tmp_path / "lake/away")
    assert jobs.promote_silver(lake) is None
    assert rows_of(lake.table("payments_events")) == before


@pytest.mark.parametrize(
    "text",
    [
        '[{"transaction_id": "x", ',
        json.dumps(event(amount="lots")),
        json.dumps(event(at="garbage")),
    ],
    ids=["truncated", "wrong type", "bad time"],
)
def test_bad_input_fails_and_leaves_silver_alone(lake, text):
    write_bronze(lake, [event(f"t{i}") for i in range(3)], name="good")
    jobs.promote_silver(lake)
    before = rows_of(lake.table("payments_events"))
    write_text(f"{lake.bronze}/dt=2026-08-06/bad.json", text)
    with pytest.raises((PySparkException, Py4JJavaError)):
        jobs.promote_silver(lake)
    assert rows_of(lake.table("payments_events")) == before


def settled(spark, *events):
    flat = flatten(bronze_frame(spark, events))
    result = settled_revenue_by_merchant(fct_transactions(flat), dim_merchants(flat))
    return [tuple(row) for row in result.collect()]


def test_refunded_transactions_leave_revenue(spark):
    rows = settled(
        spark, event("t1"), event("t2", amount=4.0), event("t2", "refunded", LATER, amount=4.0)
    )
    assert rows == [("Shop", "retail", 1, 10.5)]


def test_renamed_merchant_counts_under_both_names(spark):
    rows = settled(
        spark, event("t1"), event("t2", amount=1.0, merchant={"name": "Shop & Co"})
    )
    assert sorted(rows) == [("Shop", "retail", 2, 11.5), ("Shop & Co", "retail", 2, 11.5)]


def test_same_named_merchants_share_a_row(spark):
    rows = settled(spark, event("t1"), event("t2", amount=1.25, merchant={"merchant_id": "m2"}))
    assert rows == [("Shop", "retail", 2, 11.75)]


def test_currencies_are_summed_as_they_are(spark):
    rows = settled(spark, event("t1", currency="EUR"), event("t2", currency="USD"))
    assert rows == [("Shop", "retail", 2, 21.0)]


def test_unknown_merchant_is_not_joined(spark):
    rows = settled(spark, event("t1"), event("t2", merchant={"merchant_id": None}))
    assert rows == [("Shop", "retail", 1, 10.5)]


def test_sums_do_not_depend_on_order(spark):
    from pyspark.sql import functions as F

    from tallyhouse.operators.current_state import fact

    base = flatten(bronze_frame(spark, [event()]))
    cents = F.when(F.col("id") == 0, 9e15).when(F.col("id") == 50_000, -9e15).otherwise(0.01)
    rows = spark.range(100_000).crossJoin(base.drop("amount")).withColumn("amount", cents)
    facts, merchants = fact(rows.select(*base.columns)), dim_merchants(base)
    for parts in (1, 7, 13):
        (row,) = settled_revenue_by_merchant(facts.repartition(parts), merchants).collect()
        assert row["total_settled_amount"] == 999.98


@pytest.mark.parametrize("amounts, total", [
    ([1.0, float("nan")], float("nan")),
    ([1.0, float("inf")], float("inf")),
    ([float("inf"), float("-inf")], float("nan")),
    ([1e19, 2.5], 1e19 + 2.5),
    ([1e30, 1.0], 1e30 + 1.0),
    ([None, None], None),
    ([None, 1.25], 1.25),
    ([0.0000004] * 30_000, 0.01),
])
def test_no_amount_is_left_out_of_the_sum(spark, amounts, total):
    from tallyhouse.operators.current_state import fact

    base = flatten(bronze_frame(spark, [event()]))
    rows = spark.createDataFrame([(a,) for a in amounts], "amount double").crossJoin(base.drop("amount"))
    facts = fact(rows.select(*base.columns))
    (row,) = settled_revenue_by_merchant(facts.repartition(3), dim_merchants(base)).collect()
    assert row["settled_transactions"] == len(amounts)
    got = row["total_settled_amount"]
    assert got == total or total != total and got != got
