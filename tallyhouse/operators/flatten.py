"""Bronze to silver: one row per event, no nesting, typed time, day partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyhouse.functions import event_day, parse_event_time
from tallyhouse.schemas import BRONZE_EVENT, EVENT_DAY, FLAT_COLUMNS, UNKNOWN, FlatColumn
from tallyhouse.session import require_utc


def _read(column: FlatColumn) -> Column:
    value = F.col(column.path)
    if column.name == "event_timestamp":
        value = parse_event_time(value)
    return value.alias(column.name)


def flatten(bronze: DataFrame) -> DataFrame:
    """The silver columns and ``dt``, the UTC day the event occurred.

    ``dt`` is taken from the parsed time, so it does not follow the folder a
    bronze file lies in.
    """
    require_utc(bronze.sparkSession)
    events = bronze.select(*[_read(column) for column in FLAT_COLUMNS])
    return with_event_day(events)


def flatten_openly(texts: DataFrame) -> DataFrame:
    """The silver columns, what the declared schema lacks as a VARIANT, and ``dt``.

    ``texts`` has the JSON text of one event a row. Unknown fields keep their names and
    nesting, those inside merchant, customer and payment method under these names; the
    column is null where there are none. Text that is not JSON of the declared types fails
    the job, as it does without this column.
    """
    require_utc(texts.sparkSession)
    strict = {"mode": "FAILFAST"}
    event = F.from_json("value", BRONZE_EVENT, strict)
    own = F.from_json("value", "map<string,variant>", strict)
    nested = [f.name for f in BRONZE_EVENT.fields if isinstance(f.dataType, StructType)]
    inner = F.from_json("value", ", ".join(f"{n} map<string,variant>" for n in nested), strict)
    parsed = texts.select(event.alias("event"), own.alias("own"), inner.alias("inner"))

    def undeclared(fields: Column, declared: StructType) -> Column:
        return F.map_filter(fields, lambda name, _: ~name.isin(declared.fieldNames()))

    parts = [
        F.struct(F.lit(n).alias("key"), undeclared(F.col(f"inner.{n}"), BRONZE_EVENT[n].dataType)
                 .alias("fields"))
        for n in nested
    ]
    within = F.map_from_entries(F.transform(
        F.filter(F.array(*parts), lambda part: F.size(part["fields"]) > 0),
        lambda part: F.struct(part["key"], F.to_variant_object(part["fields"])),
    ))
    unknown = F.map_concat(undeclared(F.col("own"), BRONZE_EVENT), within)
    return with_event_day(
        parsed.select("event.*", unknown.alias("unknown")).select(
            *[_read(column) for column in FLAT_COLUMNS],
            F.when(F.size("unknown") > 0, F.to_variant_object("unknown")).alias(UNKNOWN.name),
        )
    )


def with_event_day(events: DataFrame) -> DataFrame:
    return events.withColumn(EVENT_DAY.name, event_day(F.col("event_timestamp")))
