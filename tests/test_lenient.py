"""Quarantine of what cannot be read, and fields that no schema declares."""

import json

import pytest

from tallyhouse.operators.quarantine import NOT_A_TIME, NOT_JSON
from tallyhouse.plans import jobs, lenient
from tallyhouse.sources.catalog import location
from tests.conftest import event, rows_of, write_bronze, write_text


def quarantined(lake):
    rows = lake.table(lenient.QUARANTINED_EVENTS).collect()
    return sorted((r["reason"], r["record"], r["dt"]) for r in rows)


def test_broken_records_are_set_apart_and_all_others_promoted(lake):
    day = f"{lake.bronze}/dt=2026-08-06"
    good = [event("t1"), event("t2", at=None), event(None), event("t3", "chargeback")]
    write_bronze(lake, good)
    cut = '{"transaction_id": "t4", "event_'
    wrong = json.dumps(event("t5", amount="ten"))
    write_text(f"{day}/cut.json", "\n".join([cut, json.dumps(event("t6")), wrong, ""]))
    write_text(f"{day}/array.json", json.dumps([event("t7"), event("t8", at="soon")]) + "\n[{]")
    assert lenient.promote_with_quarantine(lake) is not None
    found = quarantined(lake)
    assert [(reason, dt) for reason, _, dt in found] == [
        (NOT_A_TIME, "2026-08-06"), *[(NOT_JSON, "2026-08-06")] * 3
    ]
    assert json.loads(found[0][1])["event_timestamp"] == "soon"
    assert {record for _, record, _ in found[1:]} == {cut, wrong, "[{]"}
    ids = [r["transaction_id"] for r in lake.table("payments_events").collect()]
    assert sorted(map(str, ids)) == ["None", "t1", "t2", "t3", "t6", "t7"]
    # The strict promotion still fails, and leaves both tables as they are.
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        jobs.promote_silver(lake)
    assert quarantined(lake) == found and lake.table("payments_events").count() == 6


def test_without_broken_records_it_is_the_strict_promotion(lake):
    write_bronze(lake, [event("t1"), event("t2", "refunded", "2026-08-07T00:00:00Z"), event("t1")])
    lenient.promote_with_quarantine(lake)
    lenient_rows = rows_of(lake.table("payments_events"))
    assert quarantined(lake) == []
    jobs.promote_silver(lake)
    assert rows_of(lake.table("payments_events")) == lenient_rows
    first = location(lake, "payments_events")
    lenient.promote_with_quarantine(lake)
    lenient.promote_with_quarantine(lake)
    assert rows_of(lake.table("payments_events")) == lenient_rows != first


def test_nothing_readable_leaves_silver_alone(lake):
    assert lenient.promote_with_quarantine(lake) is None
    write_bronze(lake, [event("t1")])
    lenient.promote_with_quarantine(lake)
    kept = rows_of(lake.table("payments_events"))
    for file in __import__("pathlib").Path(lake.bronze).rglob("*.json"):
        file.write_text("{broken\n")
    assert lenient.promote_with_quarantine(lake) is None
    assert rows_of(lake.table("payments_events")) == kept and len(quarantined(lake)) == 1


def unknown(lake):
    rows = lake.table(lenient.OPEN_EVENTS).collect()
    return {r["transaction_id"]: r["unknown"] and json.loads(r["unknown"].toJson()) for r in rows}


def test_unknown_fields_are_kept_at_any_depth(lake):
    plain = event("t1")
    nested = event("t2", device={"os": "ios", "tags": [1, None, {"a": 2.5}]}, merchant={"mcc": 5411})
    inner = event("t3", customer={"tier": {"name": "gold"}}, risk=None)
    write_bronze(lake, [plain, nested])
    write_text(f"{lake.bronze}/dt=2026-08-06/array.json", json.dumps([inner, event("t4", at=None)]))
    lenient.promote_openly(lake)
    assert unknown(lake) == {
        "t1": None,
        "t2": {"device": {"os": "ios", "tags": [1, None, {"a": 2.5}]}, "merchant": {"mcc": 5411}},
        "t3": {"risk": None, "customer": {"tier": {"name": "gold"}}},
        "t4": None,
    }
    jobs.promote_silver(lake)
    open_rows = rows_of(lake.table(lenient.OPEN_EVENTS).drop("unknown"))
    assert open_rows == rows_of(lake.table("payments_events"))


def test_open_promotion_is_as_strict(lake):
    write_text(f"{lake.bronze}/dt=2026-08-06/cut.json", '{"transaction_id": "t4", "event_')
    with pytest.raises(Exception, match="(?i)malformed|parse|json"):
        lenient.promote_openly(lake)
    assert lake.exists(lenient.OPEN_EVENTS) is False
