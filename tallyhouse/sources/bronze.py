"""Bronze: the event log as received, JSON by event day, append-only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyhouse.functions import landing_day
from tallyhouse.schemas import BRONZE_EVENT, BRONZE_STORED, CORRUPT, EVENT_DAY
from tallyhouse.sizing import GZIP_DENSE, MB, day_partitions

JSON_FILES = "*.{json,json.gz}"
#: Bytes of text in a bronze file, on average, from which on it makes a silver file as it is.
LARGE_FILE = 64 * MB


def land_bronze(events: DataFrame, path: str, compression: str | None = None) -> None:
    """Append a run's events, each under the day it occurred.

    The day is that of the parsed time, as in silver, so an offset counts; events
    without a readable time lie in a folder of their own. Nothing that is already
    there is touched, so running this twice lands the events twice. Lines are written one
    event each, which keeps files splittable unless they are compressed (``gzip``).
    The rebalance gathers a day's events into few files and splits a day that is
    larger than the advisory partition size.
    """
    (
        events.withColumn(EVENT_DAY.name, landing_day(F.col("event_timestamp")))
        .hint("rebalance", day_partitions(events.sparkSession), EVENT_DAY.name)
        .write.mode("append")
        .partitionBy(EVENT_DAY.name)
        .json(path, compression=compression)
    )


def _read(
    spark: SparkSession, path: str | list[str], schema: StructType, base: str, **options: object
) -> DataFrame:
    reader = spark.read.schema(schema).option("basePath", base)
    options = {"pathGlobFilter": JSON_FILES, **options}
    try:
        return reader.options(**options).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_bronze(
    spark: SparkSession, path: str, multi_line: bool = False, files: list[str] | None = None
) -> DataFrame:
    """Every event under ``path``, with the day folder it lies in as ``dt``.

    A file holds one event or one array of events per line; ``multi_line`` is
    for pretty-printed arrays only, since it reads one value per file. Unknown
    fields are ignored, absent ones are null, and anything that is not JSON of
    the declared types fails the job. ``files`` are the only ones to read.
    """
    return _read(
        spark, files or path, BRONZE_STORED, path, mode="FAILFAST", multiLine=multi_line
    )


def read_bronze_leniently(
    spark: SparkSession, path: str, multi_line: bool = False, pattern: str = JSON_FILES
) -> DataFrame:
    """The same, but text that is not JSON of the declared types is a row of its own.

    Such a row has the text in ``_corrupt_record``, which is null for all others.
    ``pattern`` says which files are read.
    """
    schema = StructType([*BRONZE_EVENT.fields, CORRUPT, EVENT_DAY])
    return _read(
        spark, path, schema, path, mode="PERMISSIVE", multiLine=multi_line,
        columnNameOfCorruptRecord=CORRUPT.name, pathGlobFilter=pattern,
    )


def read_bronze_texts(spark: SparkSession, path: str) -> DataFrame:
    """Every event as the JSON text it came as (``value``), arrays on a line taken apart."""
    schema = StructType([StructField("value", StringType()), EVENT_DAY])
    reader = spark.read.schema(schema).option("pathGlobFilter", JSON_FILES)
    lines = reader.text(path).where("trim(value) != ''")
    elements = F.when(
        F.ltrim("value").startswith("["),
        F.from_json("value", "array<string>", {"mode": "FAILFAST"}),
    ).otherwise(F.array("value"))
    return lines.select(F.explode(elements).alias("value"), EVENT_DAY.name)


def bronze_files(spark: SparkSession, path: str, pattern: str = JSON_FILES) -> DataFrame:
    """Bronze objects by day and size, from their listing; no file is opened."""
    try:
        listing = (
            spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        )
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "dt string, length bigint, file string")
    file = F.col("_metadata.file_path").alias("file")
    return listing.select(folder_day(F.col("path")).alias(EVENT_DAY.name), "length", file)


def folder_day(path: Column) -> Column:
    """The day of the bronze folder a file lies in."""
    return F.regexp_extract(path, f"/{EVENT_DAY.name}=([^/]+)/", 1)


@dataclass(frozen=True)
class Listing:
    """What a listing says of bronze: its bytes, how dense they are, how it is cut."""

    size: int
    dense: int
    scattered: bool


def listing_of(files: DataFrame) -> Listing:
    """Sums over a listing. Files are scattered when there are more than one for each day
    and one for each ``LARGE_FILE`` bytes of their text."""
    zipped = F.when(F.col("file").endswith(".gz"), F.col("length")).otherwise(0)
    sums = files.agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("size"),
        F.coalesce(F.sum(zipped), F.lit(0)).alias("zipped"),
        F.count(F.lit(1)).alias("files"),
        F.count_distinct(EVENT_DAY.name).alias("days"),
    ).first()
    text = sums["size"] + sums["zipped"] * (GZIP_DENSE - 1)
    dense = max(1, text // max(sums["size"], 1))
    return Listing(sums["size"], dense, sums["files"] > sums["days"] + text // LARGE_FILE)
