"""Current state against a plain Python definition, on arbitrary small logs."""

import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyhouse.functions import LIFECYCLE_RANK
from tallyhouse.operators.activity import distinct_transactions, tied_transactions
from tallyhouse.operators.current_state import current_state, current_state_by_max
from tallyhouse.schemas import EVENT

COLUMNS = EVENT.fieldNames()


@st.composite
def events(draw):
    row = dict.fromkeys(COLUMNS, "x")
    row["transaction_id"] = draw(st.sampled_from(["t1", "t2", "t3", None]))
    row["event_type"] = draw(st.sampled_from([*LIFECYCLE_RANK, "chargeback", None]))
    minute = draw(st.one_of(st.none(), st.integers(0, 3)))
    row["event_timestamp"] = None if minute is None else datetime.datetime(2026, 8, 6, 10, minute)
    row["amount"] = draw(st.sampled_from([1.0, 2.0]))
    row["merchant_id"] = draw(st.sampled_from(["m1", "m2", None]))
    return tuple(row[c] for c in COLUMNS)


def order(row):
    """Null before everything; time, rank, type, then what revenue needs."""
    row = dict(zip(COLUMNS, row))
    rank = LIFECYCLE_RANK.get(row["event_type"])
    keys = [row["event_timestamp"], rank, row["event_type"], row["amount"], row["merchant_id"]]
    return [(key is not None, key) if key is not None else (False,) for key in keys]


def expected(rows):
    latest = {}
    for row in rows:
        best = latest.get(row[0])
        if best is None or order(row) > order(best):
            latest[row[0]] = row
    return sorted(latest.values(), key=repr)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(events(), min_size=1, max_size=14), st.randoms())
def test_current_state_is_the_maximum(spark, rows, rng):
    shuffled = rows[:]
    rng.shuffle(shuffled)
    for log in (rows, shuffled):
        frame = spark.createDataFrame(log, EVENT).repartition(3)
        for plan in (current_state, current_state_by_max):
            result = plan(frame).select(*COLUMNS)
            assert sorted((tuple(r) for r in result.collect()), key=repr) == expected(rows)


def test_counts_ignore_a_null_transaction(spark):
    row = dict.fromkeys(COLUMNS, "x") | {
        "event_timestamp": datetime.datetime(2026, 8, 6), "amount": 1.0,
    }
    rows = [tuple((row | {"transaction_id": t}).values()) for t in ("t1", "t1", "t2", None)]
    frame = spark.createDataFrame(rows, EVENT)
    assert tuple(distinct_transactions(frame).first()) == (4, 2)
    assert [tuple(r)[0::2] for r in tied_transactions(frame).collect()] == [("t1", 2)]
    assert tuple(distinct_transactions(frame.where("false")).first()) == (0, 0)
