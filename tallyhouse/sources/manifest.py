"""A manifest of bronze: per file and event day the events and their first and last time.

It grows by the files it lacks. These are told from the listing, so files that somebody
else landed are found too, and no file is read twice. What it says can be had from bronze
again at any time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import event_day, parse_event_time
from tallyhouse.schemas import EVENT_DAY, MANIFEST
from tallyhouse.sources.bronze import bronze_files, read_bronze
from tallyhouse.sources.catalog import Lake


def _path(lake: Lake) -> str:
    return f"{lake.root}/bronze_manifest"


def manifest(lake: Lake) -> DataFrame:
    """What has been recorded: file, dt (null without a time), n_events, oldest, newest."""
    try:
        return lake.spark.read.schema(MANIFEST).parquet(_path(lake))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return lake.spark.createDataFrame([], MANIFEST)


def manifest_of(
    lake: Lake, files: DataFrame, multi_line: bool = False, only: list[str] | None = None
) -> DataFrame:
    """The manifest rows of files (``file``), read from bronze; an empty file has one of 0."""
    bronze = read_bronze(lake.spark, lake.bronze, multi_line, only)
    at = parse_event_time(F.col("event_timestamp"))
    counted = (
        bronze.select(F.col("_metadata.file_path").alias("file"), at.alias("at"))
        .groupBy("file", event_day(F.col("at")).alias(EVENT_DAY.name))
        .agg(F.count(F.lit(1)).alias("n_events"), F.min("at").alias("oldest"),
             F.max("at").alias("newest"))
    )
    return files.select("file").join(counted, "file", "left").select(
        "file", EVENT_DAY.name, F.coalesce("n_events", F.lit(0)).alias("n_events"),
        "oldest", "newest",
    )


def record_landings(lake: Lake, multi_line: bool = False) -> int:
    """Record the files that the manifest lacks, reading these alone; tells how many."""
    known = manifest(lake).select("file").distinct()
    new = bronze_files(lake.spark, lake.bronze).join(known, "file", "left_anti")
    # One path for each newly landed file; a first recording reads the folder instead.
    first = known.isEmpty()
    paths = [] if first else [row["file"] for row in new.select("file").collect()]
    if not paths and not (first and not new.isEmpty()):
        return 0
    landed = new if first else lake.spark.createDataFrame([(p,) for p in paths], "file string")
    rows = manifest_of(lake, landed, multi_line, paths or None)
    # A file's rows go together, so that a commit that dies half way leaves whole files out.
    rows.repartition("file").write.mode("append").parquet(_path(lake))
    return new.count() if first else len(paths)
