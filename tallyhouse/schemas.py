"""The data model, declared once.

Only the nested bronze event is written out. The flat silver columns, their
types, the select list that produces them and the table DDL all follow from it,
so there is no second column list to keep in step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    VariantType,
)


def _strings(*names: str) -> StructType:
    return StructType([StructField(name, StringType()) for name in names])


# The field names of an event, as producers write them.
BRONZE_EVENT = StructType(
    [
        StructField("transaction_id", StringType()),
        StructField("event_type", StringType()),
        StructField("event_timestamp", StringType()),  # ISO-8601, UTC
        StructField("amount", DoubleType()),
        StructField("currency", StringType()),
        StructField("merchant", _strings("merchant_id", "name", "category")),
        StructField("customer", _strings("customer_id", "name", "email")),
        StructField("payment_method", _strings("type", "brand", "last4", "token")),
    ]
)

EVENT_DAY = StructField("dt", StringType())
# The folder Spark puts rows without a day in; they read back with a null day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"

# Text of bronze that is not JSON of the declared types, while it is read.
CORRUPT = StructField("_corrupt_record", StringType())
# What bronze has that is not declared, as it came.
UNKNOWN = StructField("unknown", VariantType())

# The part of the current state a transaction belongs to, where it is kept in parts.
BUCKET = StructField("bucket", IntegerType())

# Columns that change type between bronze and silver.
_SILVER_TYPES: dict[str, DataType] = {"event_timestamp": TimestampNTZType()}


@dataclass(frozen=True)
class FlatColumn:
    """One silver column and the bronze path it is read from."""

    name: str
    path: str
    data_type: DataType


def _flatten(schema: StructType) -> list[FlatColumn]:
    columns = []
    for field in schema.fields:
        if not isinstance(field.dataType, StructType):
            data_type = _SILVER_TYPES.get(field.name, field.dataType)
            columns.append(FlatColumn(field.name, field.name, data_type))
            continue
        for inner in field.dataType.fields:
            prefixed = inner.name.startswith(f"{field.name}_")
            name = inner.name if prefixed else f"{field.name}_{inner.name}"
            columns.append(FlatColumn(name, f"{field.name}.{inner.name}", inner.dataType))
    return columns


def _struct(columns: list[tuple[str, DataType]]) -> StructType:
    return StructType([StructField(name, data_type) for name, data_type in columns])


FLAT_COLUMNS = _flatten(BRONZE_EVENT)
EVENT = _struct([(c.name, c.data_type) for c in FLAT_COLUMNS])

# Bronze and silver as stored: the event plus its day partition.
BRONZE_STORED = StructType([*BRONZE_EVENT.fields, EVENT_DAY])
SILVER_STORED = StructType([*EVENT.fields, EVENT_DAY])
SILVER_OPEN = StructType([*EVENT.fields, UNKNOWN, EVENT_DAY])
QUARANTINE = StructType([*_strings("reason", "record").fields, EVENT_DAY])
MANIFEST = StructType(
    [
        StructField("file", StringType()),
        EVENT_DAY,
        StructField("n_events", LongType()),
        StructField("oldest", TimestampNTZType()),
        StructField("newest", TimestampNTZType()),
    ]
)

# Descriptive columns live in the dimensions; the fact keeps their keys.
MERCHANT_COLUMNS = [c.name for c in FLAT_COLUMNS if c.path.startswith("merchant.")]
CUSTOMER_COLUMNS = [c.name for c in FLAT_COLUMNS if c.path.startswith("customer.")]
DIMENSION_KEYS = {"dim_merchants": "merchant_id", "dim_customers": "customer_id"}
_FACT_RENAMES = {"event_type": "status", "event_timestamp": "last_event_at"}
FACT_COLUMNS = {
    c.name: _FACT_RENAMES.get(c.name, c.name)
    for c in FLAT_COLUMNS
    if c.name not in {*MERCHANT_COLUMNS, *CUSTOMER_COLUMNS} - set(DIMENSION_KEYS.values())
}

FACT = _struct([(alias, EVENT[name].dataType) for name, alias in FACT_COLUMNS.items()])
DIM_MERCHANTS = _struct([(name, EVENT[name].dataType) for name in MERCHANT_COLUMNS])
DIM_CUSTOMERS = _struct([(name, EVENT[name].dataType) for name in CUSTOMER_COLUMNS])

REVENUE = _struct(
    [
        ("merchant_name", StringType()),
        ("merchant_category", StringType()),
        ("settled_transactions", LongType()),
        ("total_settled_amount", DoubleType()),
    ]
)


def columns_ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" for f in schema.fields)


def types_of(schema: StructType) -> list[tuple[str, str]]:
    """Names and types in order, leaving nullability aside."""
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]
