"""Wall time of every registered query; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Queries run to
the no-op sink, so every row is computed and none is brought to the driver. The
stored layers that some of them read are built first, timed under ``stages``
(landing and arrivals once, since a second run would do different work);
``variants`` compares alternative plans for the same result. Each number is the
shorter of two runs.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

from tallyhouse import queries
from tallyhouse.operators import current_state
from tallyhouse.plans import jobs
from tallyhouse.session import build_session
from tallyhouse.sources import tables
from tallyhouse.streaming.arrivals import promote_arrivals

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2


def timed(job: Callable[[], object]) -> float:
    start = time.perf_counter()
    job()
    return round(time.perf_counter() - start, 3)


def best(job: Callable[[], object], runs: int = RUNS) -> float:
    return min(timed(job) for _ in range(runs))


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def query(name: str) -> Callable[[], None]:
        return lambda: run(getattr(queries, name)(spark, SF_DIR))

    warm_up = timed(query("settled_revenue_by_merchant"))

    lake = queries.new_lake(spark)
    stages = {
        "ingest": timed(lambda: jobs.ingest(lake, tables.bronze_events(spark, SF_DIR))),
        "promote_silver": best(lambda: jobs.promote_silver(lake)),
        "build_current": best(lambda: jobs.build_current(lake)),
        "build_marts": best(lambda: jobs.build_marts(lake, lake.table("payments_current"))),
        "serve": best(lambda: run(jobs.serve(lake))),
        "promote_arrivals": timed(lambda: promote_arrivals(lake)),
    }
    silver = lake.table("payments_events")
    variants = {
        "current_by_window": best(lambda: run(current_state.current_state(silver))),
        "current_by_max": best(lambda: run(current_state.current_state_by_max(silver))),
        "scan_one_day": best(lambda: run(silver.where(silver.dt == queries.ONE_DAY))),
        "scan_all_days": best(lambda: run(silver)),
        "promote_compacted": best(lambda: jobs.promote_silver(lake, compact=True)),
        "promote_uncompacted": best(lambda: jobs.promote_silver(lake, compact=False)),
    }

    queries.built_lake(spark, SF_DIR)
    times = {q.__name__: best(query(q.__name__)) for q in queries.REGISTERED}
    print(
        json.dumps(
            {
                "metric": "total wall time of all registered queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(Path(SF_DIR).name.removeprefix("sf")),
                "stages": stages,
                "variants": variants,
                "warm_up": warm_up,
                "runs": RUNS,
                "cpus": int(CPUS),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
