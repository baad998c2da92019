"""Run the lakehouse jobs with spark-submit.

    spark-submit --py-files tallyhouse.zip job.py --root s3a://bucket/lake \
        --database payments silver current marts serve

Steps run in the order given and stop at the first failure. Tables live in the
session's catalog; steps submitted separately need one that outlasts a session
(spark.sql.catalogImplementation=hive or a catalog of the cluster's own).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.quality import require_quality
from tallyhouse.plans import checks, jobs, layouts, lenient
from tallyhouse.schemas import REVENUE
from tallyhouse.session import build_session
from tallyhouse.sources.catalog import Lake
from tallyhouse.sources.export import read_tsv, write_tsv
from tallyhouse.streaming.arrivals import (
    ARRIVED_CURRENT,
    build_marts_from_arrivals,
    promote_arrivals,
)


def _report(counts: DataFrame) -> None:
    for row in counts.orderBy(counts.columns[0]).collect():
        print(f"{row[0]}: {row[1]} rows")


def silver(lake: Lake, multi_line: bool) -> None:
    change = jobs.promote_silver(lake, multi_line=multi_line)
    if change is None:
        print("no bronze events; silver is left as it is")
        return
    print(f"days added {change.added}, existing {change.existing}, removed {change.removed}")
    _report(jobs.silver_report(lake))
    _report(jobs.table_counts(lake, "payments_events"))


def current(lake: Lake, multi_line: bool) -> None:
    jobs.build_current(lake)
    _report(jobs.table_counts(lake, "payments_current"))


def marts(lake: Lake, multi_line: bool, rows: DataFrame | None = None) -> None:
    jobs.build_marts(lake, rows)
    _report(jobs.table_counts(lake, "fct_transactions", "dim_merchants", "dim_customers"))


def arrivals(lake: Lake, multi_line: bool) -> None:
    promote_arrivals(lake, multi_line=multi_line)
    _report(jobs.table_counts(lake, ARRIVED_CURRENT))


def arrived_marts(lake: Lake, multi_line: bool) -> None:
    build_marts_from_arrivals(lake)
    _report(jobs.table_counts(lake, "fct_transactions", "dim_merchants", "dim_customers"))


def sorted_silver(lake: Lake, multi_line: bool) -> None:
    """Silver and quarantine from one reading of bronze."""
    if lenient.promote_with_quarantine(lake, multi_line) is None:
        print("no readable bronze events; silver is left as it is")
        return
    _report(jobs.table_counts(lake, "payments_events", lenient.QUARANTINED_EVENTS))


def open_silver(lake: Lake, multi_line: bool) -> None:
    if lenient.promote_openly(lake) is not None:
        _report(jobs.table_counts(lake, lenient.OPEN_EVENTS))


def compact(lake: Lake, multi_line: bool) -> None:
    print(f"days compacted {len(layouts.compact_silver(lake))}")


def cluster(lake: Lake, multi_line: bool) -> None:
    layouts.cluster_events(lake)
    _report(jobs.table_counts(lake, layouts.CLUSTERED))


def quality(lake: Lake, multi_line: bool) -> None:
    require_quality(checks.quality_violations(lake))


def serve(lake: Lake, multi_line: bool) -> None:
    path = f"{lake.root}/results/settled_revenue_by_merchant"
    write_tsv(jobs.serve(lake), path)
    rows = read_tsv(lake.spark, path, REVENUE)
    _report(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("result"), "n"))


STEPS = {
    step.__name__: step
    for step in (
        silver, sorted_silver, open_silver, compact, cluster, arrivals, current, marts,
        arrived_marts, quality, serve,
    )
}


def run(lake: Lake, steps: list[str], multi_line: bool = False) -> None:
    """Run the steps; marts reuse the current state if this run has built it."""
    done: set[str] = set()
    for step in steps:
        if step == "marts" and "current" in done:
            marts(lake, multi_line, lake.table("payments_current"))
        else:
            STEPS[step](lake, multi_line)
        done.add(step)


def main() -> None:
    parser = argparse.ArgumentParser(description="Rebuild layers of a payments lake.")
    parser.add_argument("--root", required=True, help="folder the lake's files lie in")
    parser.add_argument("--database", default="payments")
    parser.add_argument(
        "--multi-line", action="store_true", help="bronze files are pretty-printed arrays"
    )
    parser.add_argument("steps", nargs="+", choices=STEPS)
    args = parser.parse_args()
    spark = build_session("payments lake")
    try:
        run(Lake(spark, args.root.rstrip("/"), args.database), args.steps, args.multi_line)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
