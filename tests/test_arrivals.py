"""Promotion that follows arrivals gives what a rebuild gives, and costs what arrived."""

import json
from pathlib import Path

import pytest

from tallyhouse.operators.flatten import flatten
from tallyhouse.plans import jobs
from tallyhouse.schemas import NO_DAY
from tallyhouse.sources import catalog, tables
from tallyhouse.streaming import arrivals
from tests.conftest import SF, bronze_frame, event, plan_of, rows_of, write_bronze, write_text


@pytest.fixture(autouse=True)
def few_buckets(request, monkeypatch):
    """Two buckets, for the tests that are not about them."""
    if "buckets" not in request.node.name:
        monkeypatch.setattr(arrivals, "BUCKETS", (2, 4_096))


def promoted(lake):
    return rows_of(arrivals.arrived_log(lake)), rows_of(arrivals.arrived_current(lake))


def rebuilt(lake):
    jobs.promote_silver_and_current(lake)
    return rows_of(lake.table("payments_events")), rows_of(lake.table("payments_current"))


def files(lake, folder):
    return {str(f) for f in Path(f"{lake.root}/{folder}").rglob("*.parquet")}


def state_files(lake):
    found = catalog.stored_files(lake, arrivals.ARRIVED_CURRENT).collect()
    return {(row["bucket"], row["path"]) for row in found}


def test_arrivals_equal_a_rebuild(spark, lake):
    jobs.ingest(lake, tables.bronze_events(spark, SF))
    arrivals.promote_arrivals(lake, files_per_batch=3)
    assert arrivals.live_runs(lake)[-1][1] > 0
    assert promoted(lake) == rebuilt(lake)


def test_only_new_files_are_promoted(lake):
    write_bronze(lake, [event("t1", "settled", "2026-08-02T10:00:00Z"), event("t2", "created")])
    write_text(f"{lake.bronze}/dt={NO_DAY}/x.json", json.dumps(event("t2", "refunded", at=None)))
    arrivals.promote_arrivals(lake)
    arrivals.promote_arrivals(lake)
    assert arrivals.arrived_log(lake).count() == 3
    # One event arrives late, one supersedes, one is of a new transaction.
    write_bronze(
        lake,
        [
            event("t1", "created", "2026-08-01T10:00:00Z"),
            event("t2", "authorized", "2026-08-07T10:00:00Z"),
            event("t3", "created"),
            event(None, "created"),
        ],
    )
    arrivals.promote_arrivals(lake)
    current = arrivals.arrived_current(lake).collect()
    status = {r["transaction_id"]: r["event_type"] for r in current}
    assert status == {"t1": "settled", "t2": "authorized", "t3": "created", None: "created"}
    assert promoted(lake) == rebuilt(lake)


def test_a_small_batch_writes_only_its_buckets(spark, lake):
    """A few transactions of a state of 1,500: the other buckets keep their files."""
    jobs.ingest(lake, tables.bronze_events(spark, SF))
    arrivals.promote_arrivals(lake)
    before, written = state_files(lake), files(lake, "replaced") | files(lake, "gold")
    assert len({bucket for bucket, _ in before}) == arrivals.BUCKETS[0]
    late = [event("txn_000000000007", "refunded", "2026-08-07T10:00:00Z"), event("new")]
    write_bronze(lake, late)
    arrivals.promote_arrivals(lake)
    after = state_files(lake)
    changed = {bucket for bucket, _ in before ^ after}
    assert 1 <= len(changed) <= len(late)
    new = (files(lake, "replaced") | files(lake, "gold")) - written
    assert len(new) == len(changed)
    assert {bucket for bucket, _ in after - before} == changed
    assert promoted(lake) == rebuilt(lake)


def test_the_merge_reads_only_its_buckets(spark, lake):
    write_bronze(lake, [event(f"t{k}") for k in range(200)])
    arrivals.promote_arrivals(lake)
    from pyspark.sql import functions as F

    from tallyhouse.operators.current_state import merged_state

    state = lake.table(arrivals.ARRIVED_CURRENT).where(F.col("bucket").isin([3]))
    arrived = flatten(bronze_frame(spark, [event("t1")]))
    plan = plan_of(merged_state(state, arrived, arrivals.BUCKETS[0]))
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    # The state is shuffled once, by bucket; the batch once more before, by transaction.
    assert plan.count("hashpartitioning(bucket") >= 1
    assert plan.count("hashpartitioning(transaction_id") == 1


@pytest.mark.parametrize("dies_in", ["replace_partitions", "fold_runs", "_set_live"])
def test_a_batch_that_dies_and_runs_again_changes_nothing(spark, lake, monkeypatch, dies_in):
    write_bronze(lake, [event("t1"), event("t2", at="2026-08-07T10:00:00Z"), event("t3")])
    arrivals.promote_arrivals(lake)
    second = [event("t1", "refunded", "2026-08-08T10:00:00Z"), event("t9")]
    write_bronze(lake, second)

    def dies(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(arrivals, dies_in, dies)
    with pytest.raises(Exception, match="executor lost"):
        arrivals.promote_arrivals(lake)
    monkeypatch.undo()
    arrivals.promote_arrivals(lake)
    once = promoted(lake)
    assert once == rebuilt(lake)
    arrivals.promote_batch(lake, flatten(bronze_frame(spark, second)), 1)
    assert promoted(lake) == once


def test_a_job_that_dies_between_two_buckets(spark, lake, monkeypatch):
    """Some buckets point at their new folder, some at the old; the next run replaces all."""
    write_bronze(lake, [event(f"t{k}") for k in range(40)])
    arrivals.promote_arrivals(lake)
    write_bronze(lake, [event(f"t{k}", "refunded", "2026-08-08T10:00:00Z") for k in range(40)])
    run_sql, left = type(spark).sql, [3]

    def sql(self, text, *rest, **named):
        if "SET LOCATION" in text:
            left[0] -= 1
            if left[0] < 0:
                raise RuntimeError("driver lost")
        return run_sql(self, text, *rest, **named)

    monkeypatch.setattr(type(spark), "sql", sql)
    with pytest.raises(Exception, match="driver lost"):
        arrivals.promote_arrivals(lake)
    monkeypatch.undo()
    arrivals.promote_arrivals(lake)
    assert promoted(lake) == rebuilt(lake)


def test_an_outgrown_state_is_divided_anew(spark, lake, monkeypatch):
    monkeypatch.setattr(arrivals, "BUCKETS", (2, 64))
    monkeypatch.setattr(arrivals, "BUCKET_BYTES", 4_000)
    write_bronze(lake, [event("t0")])
    arrivals.promote_arrivals(lake)
    assert catalog.property_of(lake, arrivals.ARRIVED_CURRENT, "lake.buckets") == "2"
    jobs.ingest(lake, tables.bronze_events(spark, SF))
    arrivals.promote_arrivals(lake)
    assert int(catalog.property_of(lake, arrivals.ARRIVED_CURRENT, "lake.buckets")) > 2
    write_bronze(lake, [event("t0", "refunded", "2026-08-09T10:00:00Z")])
    arrivals.promote_arrivals(lake)
    assert promoted(lake) == rebuilt(lake)


def test_folds_write_each_event_once_a_tier(lake, monkeypatch):
    """Written rows stay within the tiers, and runs of other days are not touched."""
    monkeypatch.setattr(arrivals, "FAN", 2)
    written = []
    write_run = arrivals._write_run

    def counted(lake, run, events):
        write_run(lake, run, events)
        written.append(lake.spark.read.parquet(arrivals._run_folder(lake, run)).count())

    monkeypatch.setattr(arrivals, "_write_run", counted)
    batches = 9
    for run in range(batches):
        write_bronze(lake, [event(f"t{run}", at=f"2026-08-{1 + run:02d}T10:00:00Z")])
        before = files(lake, "silver/arrived")
        done = len(written)
        arrivals.promote_arrivals(lake)
        assert before <= files(lake, "silver/arrived")
        # A fold of two runs of one tier: no more than the batches they hold.
        assert sum(written[done:]) <= 1 + sum(2 << k for k in range(4))
    assert sum(written) <= batches * (1 + 3)
    assert arrivals.live_runs(lake) == [(0, 7), (8, 8)]
    last_fold = len(written)
    write_bronze(lake, [event("late", at="2026-08-20T10:00:00Z")])
    arrivals.promote_arrivals(lake)
    assert written[last_fold:] == [1, 2]  # the batch, and its fold with the one before
    assert promoted(lake) == rebuilt(lake)


def test_partitions_do_not_grow_with_runs(lake, monkeypatch):
    monkeypatch.setattr(arrivals, "FAN", 3)
    for run in range(10):
        late = event("t0", "refunded", f"2026-08-{7 + run % 2:02d}T10:00:00Z")
        write_bronze(lake, [event(f"t{run}"), late])
        arrivals.promote_arrivals(lake)
        known = arrivals._known_runs(lake)
        assert len(known) <= 2 * 3 and set(known) == {
            f"{a}-{b}" for a, b in arrivals.live_runs(lake)
        }
    assert arrivals.live_runs(lake) == [(0, 8), (9, 9)]
    assert promoted(lake) == rebuilt(lake)


def test_a_fold_that_dies_shows_no_event_twice(lake, monkeypatch):
    monkeypatch.setattr(arrivals, "FAN", 3)
    for run in range(2):
        write_bronze(lake, [event(f"t{run}")])
        arrivals.promote_arrivals(lake)
    write_bronze(lake, [event("t2")])
    monkeypatch.setattr(arrivals, "_forget_folded", lambda *_: None)
    arrivals.promote_arrivals(lake)
    monkeypatch.undo()
    assert arrivals.live_runs(lake) == [(0, 2)] and len(arrivals._known_runs(lake)) == 4
    assert promoted(lake) == rebuilt(lake)
    arrivals.fold_runs(lake)
    assert set(arrivals._known_runs(lake)) == {"0-2"} and promoted(lake) == rebuilt(lake)


def test_marts_from_arrivals_equal_those_of_a_rebuild(spark, lake):
    jobs.ingest(lake, tables.bronze_events(spark, SF))
    arrivals.promote_arrivals(lake, files_per_batch=3)
    arrivals.build_marts_from_arrivals(lake)
    arrived = rows_of(jobs.serve(lake))
    jobs.promote_silver_and_current(lake)
    jobs.build_marts(lake)
    assert arrived == rows_of(jobs.serve(lake)) and arrived
