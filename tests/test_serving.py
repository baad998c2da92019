"""What a user of the stored tables does: SQL, exports, repairs."""

from pathlib import Path

from tallyhouse.plans import jobs
from tallyhouse.schemas import REVENUE, types_of
from tallyhouse.sources import catalog, export, tables
from tests.conftest import SF, rows_of


def test_sql_over_the_catalog(spark, lake):
    result = jobs.run(lake, tables.bronze_events(spark, SF))
    by_sql = spark.sql(
        f"""
        WITH settled AS (
            SELECT merchant_id, amount FROM {lake.name("fct_transactions")}
            WHERE status = 'settled'
        )
        SELECT merchant_name, merchant_category, count(*) AS settled_transactions,
               round(sum(amount), 2) AS total_settled_amount
        FROM settled JOIN {lake.name("dim_merchants")} USING (merchant_id)
        GROUP BY ALL ORDER BY 4 DESC
        """
    )
    assert [tuple(r) for r in by_sql.collect()] == [tuple(r) for r in result.collect()]
    assert types_of(result.schema) == types_of(REVENUE)

    # Days partition the log, and the current state resolves it.
    per_day = spark.sql(f"SELECT dt, count(*) FROM {lake.name('payments_events')} GROUP BY dt")
    assert rows_of(per_day) == rows_of(jobs.silver_report(lake))
    spark.sql(f"MSCK REPAIR TABLE {lake.name('payments_events')} SYNC PARTITIONS")
    assert rows_of(per_day) == rows_of(jobs.silver_report(lake))
    open_ones = spark.sql(
        f"SELECT count(*) AS n FROM {lake.name('payments_current')}"
        " WHERE event_type IN ('created', 'authorized')"
    )
    assert open_ones.first()["n"] == 0

    # The result leaves as tab-separated text with a header, and comes back whole.
    export.write_tsv(result, f"{lake.root}/out")
    lines = [
        line
        for part in Path(f"{lake.root}/out").glob("*.csv")
        for line in part.read_text().splitlines()
    ]
    assert "\t".join(f'"{name}"' for name in REVENUE.fieldNames()) in lines
    assert rows_of(export.read_tsv(spark, f"{lake.root}/out", REVENUE)) == rows_of(result)

    # Every run lands files of its own beside those that are there.
    landed = {f for f in Path(lake.bronze).glob("dt=*/*.json")}
    contents = {f: f.read_bytes() for f in landed}
    jobs.ingest(lake, tables.bronze_events(spark, SF).limit(10))
    after = {f for f in Path(lake.bronze).glob("dt=*/*.json")}
    assert after > landed and all(f.read_bytes() == contents[f] for f in landed)
    assert catalog.registered_days(lake, "payments_events") == {
        f.parent.name.removeprefix("dt=") for f in landed
    }


def test_text_comes_back_as_it_was(spark, tmp_path):
    values = [" lead ", "", None, "a\tb", 'say "x"', "back\\slash", "\\N", "\\\\N", "line\nend", "\r\n",
              "'", '"', "é", "#c", "null", "\u00a0"]
    rows = [(k, v, None if k % 2 else k / 3) for k, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "k long, name string, amount double")
    export.write_tsv(frame, f"{tmp_path}/out")
    assert rows_of(export.read_tsv(spark, f"{tmp_path}/out", frame.schema)) == rows_of(frame)
