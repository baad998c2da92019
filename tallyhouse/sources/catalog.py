"""Catalog tables and how a rebuild replaces one.

A rebuild must not harm the table it replaces: overwriting in place empties the
folder before the new rows exist, so a failed job would leave nothing. Each
table therefore has two folders. A rebuild overwrites the one the catalog does
not point at, and only a finished rebuild is put in the table's place. A query
that is already running keeps the files it started with. A table without
partitions is pointed at its new folder in one statement. Partitions know their
own folders, so a partitioned table is swapped for a new one in two; the name is
free between them, and if a job dies there the next rebuild finishes the swap, but
only with a table that was marked complete: one that died before is built anew.

Tables that belong together are all written before the first of them is put in
place.

Single partitions are replaced the same way: each has two folders, the new rows go to
the one its partition does not point at, and then the partition is pointed there.
Partitions that are not replaced keep their files.

Partitions are registered by statements of at most ``CHUNK`` of them. A statement that
finds a partition registered is no error, so a job that died half way goes on where it
stopped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyhouse import schemas


@dataclass(frozen=True)
class TableSpec:
    schema: StructType
    folder: str
    partition_by: tuple[str, ...] = ()


TABLES = {
    "payments_events": TableSpec(schemas.SILVER_STORED, "silver/payments", ("dt",)),
    "payments_current": TableSpec(schemas.EVENT, "gold/payments_current"),
    "fct_transactions": TableSpec(schemas.FACT, "gold/fct_transactions"),
    "dim_merchants": TableSpec(schemas.DIM_MERCHANTS, "gold/dim_merchants"),
    "dim_customers": TableSpec(schemas.DIM_CUSTOMERS, "gold/dim_customers"),
}

FOLDERS = ("blue", "green")
STORED_BYTES = "lake.stored.bytes"
#: Partitions that one statement adds or drops.
CHUNK = 100
#: Where the folders of replaced partitions lie.
TABLES_FOLDER = "replaced"
#: The folder level that tells a replaced partition's two folders apart.
SIDE = "side"
COMPLETE = "lake.complete"


@dataclass(frozen=True)
class PartitionChange:
    """Days a rebuild or registration added, found in place, and removed."""

    added: int
    existing: int
    removed: int = 0


@dataclass(frozen=True)
class Lake:
    """One lakehouse: where its files lie and which database names its tables."""

    spark: SparkSession
    root: str
    database: str

    @property
    def bronze(self) -> str:
        return f"{self.root}/bronze/payments"

    def name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))


def create_database(lake: Lake) -> None:
    lake.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{lake.database}` LOCATION '{lake.root}/catalog'")


def create_table(
    lake: Lake,
    table: str,
    location: str,
    spec: TableSpec | None = None,
    properties: dict[str, str] | None = None,
) -> None:
    """An external Parquet table over ``location`` with the declared columns."""
    spec = spec or TABLES[table]
    partitioning = f"PARTITIONED BY ({', '.join(spec.partition_by)})" if spec.partition_by else ""
    noted = f"TBLPROPERTIES ({_pairs(properties)})" if properties else ""
    lake.spark.sql(
        f"CREATE TABLE IF NOT EXISTS {lake.name(table)} ({schemas.columns_ddl(spec.schema)})"
        f" USING parquet {partitioning} LOCATION '{location}' {noted}"
    )


def _pairs(properties: dict[str, str]) -> str:
    return ", ".join(f"'{key}' = '{value}'" for key, value in properties.items())


def set_properties(lake: Lake, table: str, properties: dict[str, str]) -> None:
    lake.spark.sql(f"ALTER TABLE {lake.name(table)} SET TBLPROPERTIES ({_pairs(properties)})")


def property_of(lake: Lake, table: str, key: str) -> str | None:
    properties = lake.spark.sql(f"SHOW TBLPROPERTIES {lake.name(table)}")
    noted = properties.where(f"key = '{key}'").first()
    return noted["value"] if noted else None


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of the Parquet files under a folder, from their listing."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    )
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()["bytes"]


def stored_bytes(lake: Lake, table: str) -> int:
    """What a table's files take up: noted when it was built, or else listed."""
    noted = property_of(lake, table, STORED_BYTES)
    return int(noted) if noted else folder_bytes(lake.spark, location(lake, table))


def location(lake: Lake, table: str) -> str | None:
    """The folder the catalog points at, if the table exists."""
    if not lake.exists(table):
        return None
    described = lake.spark.sql(f"DESCRIBE TABLE EXTENDED {lake.name(table)}")
    return described.where("col_name = 'Location'").first()["data_type"]


def registered_days(lake: Lake, table: str) -> set[str]:
    """The partitions the catalog knows: one short string per day."""
    if not lake.exists(table):
        return set()
    partitions = lake.spark.sql(f"SHOW PARTITIONS {lake.name(table)}").collect()
    return {row["partition"].removeprefix("dt=") for row in partitions}


def _clauses(values: Iterable[dict[str, object]]) -> list[str]:
    pairs = [", ".join(f"{column} = '{v}'" for column, v in each.items()) for each in values]
    return [f"PARTITION ({pair})" for pair in pairs]


def _in_chunks(clauses: list[str]) -> Iterator[list[str]]:
    for first in range(0, len(clauses), CHUNK):
        yield clauses[first : first + CHUNK]


def add_partitions(lake: Lake, table: str, values: Iterable[dict[str, object]]) -> None:
    """Add partitions by their column values; one that is there already is not an error."""
    for part in _in_chunks(_clauses(values)):
        lake.spark.sql(f"ALTER TABLE {lake.name(table)} ADD IF NOT EXISTS {' '.join(part)}")


def drop_partitions(lake: Lake, table: str, values: Iterable[dict[str, object]]) -> None:
    """Forget partitions of an external table; their files stay for readers that run."""
    for part in _in_chunks(_clauses(values)):
        lake.spark.sql(f"ALTER TABLE {lake.name(table)} DROP IF EXISTS {', '.join(part)}")


def register_days(lake: Lake, table: str, days: Iterable[str]) -> PartitionChange:
    """Add the day partitions that the catalog lacks and report how many of them are new."""
    wanted, known = set(days), registered_days(lake, table)
    add_partitions(lake, table, [{"dt": day} for day in sorted(wanted - known)])
    return PartitionChange(added=len(wanted - known), existing=len(wanted & known))


def sync_partitions(lake: Lake, table: str) -> PartitionChange:
    """Make the catalog's partitions those that lie in the table's folder."""
    before = registered_days(lake, table)
    lake.spark.sql(f"MSCK REPAIR TABLE {lake.name(table)} SYNC PARTITIONS")
    return _change(before, registered_days(lake, table))


def _change(before: set[str], after: set[str]) -> PartitionChange:
    return PartitionChange(len(after - before), len(after & before), len(before - after))


def _check_schema(rows: DataFrame, table: str, spec: TableSpec) -> None:
    actual, declared = schemas.types_of(rows.schema), schemas.types_of(spec.schema)
    if actual != declared:
        raise ValueError(f"{table}: columns {actual} are not the declared {declared}")


@dataclass(frozen=True)
class Staged:
    """A written table that the catalog does not name yet."""

    table: str
    spec: TableSpec
    folder: str
    properties: dict[str, str]


def stage(
    lake: Lake,
    table: str,
    rows: DataFrame,
    spec: TableSpec | None = None,
    properties: dict[str, str] | None = None,
) -> Staged:
    """Write ``rows`` to the folder of ``table`` that the catalog does not point at.

    ``rows`` may read the table itself, as the catalog names it now: a frame kept
    from before the last rebuild may still read the folder written here.
    """
    spec = spec or TABLES[table]
    _check_schema(rows, table, spec)
    create_database(lake)
    _settle_interrupted_swap(lake, table)

    live = location(lake, table)
    folder = FOLDERS[1] if live and live.endswith(f"/{FOLDERS[0]}") else FOLDERS[0]
    target = f"{lake.root}/{spec.folder}/{folder}"
    writer = rows.write.mode("overwrite").option("compression", "snappy")
    if spec.partition_by:
        writer = writer.partitionBy(*spec.partition_by)
    writer.parquet(target)
    noted = {**(properties or {}), STORED_BYTES: str(folder_bytes(lake.spark, target))}
    return Staged(table, spec, target, noted)


def put_in_place(lake: Lake, staged: Staged) -> PartitionChange:
    """Let the catalog name a staged table."""
    table, spec = staged.table, staged.spec
    if lake.exists(table) and not spec.partition_by and _has_schema(lake, table, spec):
        lake.spark.sql(f"ALTER TABLE {lake.name(table)} SET LOCATION '{staged.folder}'")
        set_properties(lake, table, staged.properties)
        return PartitionChange(0, 0)

    building = _building(table)
    lake.spark.sql(f"DROP TABLE IF EXISTS {lake.name(building)}")
    create_table(lake, building, staged.folder, spec, staged.properties)
    change = PartitionChange(0, 0)
    if spec.partition_by:
        before = registered_days(lake, table)
        sync_partitions(lake, building)
        change = _change(before, registered_days(lake, building))
    set_properties(lake, building, {COMPLETE: "true"})
    _swap(lake, table)
    return change


def publish(
    lake: Lake,
    table: str,
    rows: DataFrame,
    spec: TableSpec | None = None,
    properties: dict[str, str] | None = None,
) -> PartitionChange:
    """Rebuild ``table`` from ``rows``; the old table stays until this is done."""
    return put_in_place(lake, stage(lake, table, rows, spec, properties))


def stored_files(lake: Lake, table: str, where: Column | None = None) -> DataFrame:
    """The files a table's partitions point at: path, bytes and partition columns."""
    spec_columns = [c.name for c in lake.spark.catalog.listColumns(lake.name(table)) if c.isPartition]
    rows = lake.table(table) if where is None else lake.table(table).where(where)
    return rows.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"),
        *spec_columns,
    ).distinct()


def replace_partitions(lake: Lake, table: str, rows: DataFrame, key: str, values: list) -> None:
    """Replace the partitions ``values`` of ``key`` by ``rows``, and no other.

    ``rows`` may read these partitions. A value without rows is left an empty partition.
    The switch is one statement a partition: a job that dies between two of them leaves
    some replaced, each as a whole. Running the same replacement again replaces all.
    """
    if not values:
        return
    folder = f"{lake.root}/{TABLES_FOLDER}/{table}"
    live = stored_files(lake, table, F.col(key).isin(values)).where(
        F.col("path").contains(f"/{SIDE}={FOLDERS[0]}/")
    )
    on_first = {row[key] for row in live.select(key).distinct().collect()}
    sides = {v: FOLDERS[1] if v in on_first else FOLDERS[0] for v in values}
    side = F.when(F.col(key).isin([v for v in values if v in on_first]), FOLDERS[1]).otherwise(
        FOLDERS[0]
    )
    (
        rows.withColumn(SIDE, side)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy").partitionBy(SIDE, key).parquet(folder)
    )
    known = {r[0] for r in lake.spark.sql(f"SHOW PARTITIONS {lake.name(table)}").collect()}
    for value in values:
        target = f"{folder}/{SIDE}={sides[value]}/{key}={value}"
        change = "SET" if f"{key}={value}" in known else "ADD"
        partition = f"PARTITION ({key} = '{value}')"
        lake.spark.sql(
            f"ALTER TABLE {lake.name(table)} {partition} SET LOCATION '{target}'"
            if change == "SET"
            else f"ALTER TABLE {lake.name(table)} ADD IF NOT EXISTS {partition} LOCATION '{target}'"
        )
    # Files of a folder that is written again are listed anew.
    lake.spark.catalog.refreshTable(lake.name(table))


def _building(table: str) -> str:
    return f"{table}__building"


def _has_schema(lake: Lake, table: str, spec: TableSpec) -> bool:
    return schemas.types_of(lake.table(table).schema) == schemas.types_of(spec.schema)


def _swap(lake: Lake, table: str) -> None:
    # Both are external tables: dropping one leaves its files alone.
    lake.spark.sql(f"DROP TABLE IF EXISTS {lake.name(table)}")
    lake.spark.sql(f"ALTER TABLE {lake.name(_building(table))} RENAME TO {lake.name(table)}")


def swap_in(lake: Lake, table: str) -> None:
    """Put a table that was built under its building name in the table's place."""
    set_properties(lake, _building(table), {COMPLETE: "true"})
    _swap(lake, table)


def _settle_interrupted_swap(lake: Lake, table: str) -> None:
    """Finish the swap of a job that died in it; forget a table that died half built."""
    building = _building(table)
    if not lake.exists(building):
        return
    if property_of(lake, building, COMPLETE) == "true":
        _swap(lake, table)
    else:
        lake.spark.sql(f"DROP TABLE {lake.name(building)}")
