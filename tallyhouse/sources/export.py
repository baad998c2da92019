"""Query results as tab-separated files with a header.

All text values are quoted, so tabs, quotes and line ends in them stay as they are.
A null is written as ``\\N``, and a value that begins with a backslash gets another
one, so that null, the empty text and these two characters all differ. Files carry no
order: a reader that wants the result's order sorts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_FORMAT = {
    "sep": "\t", "header": "true", "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "lineSep": "\n",
}
_NULL = "\\N"


def _written(value: Column) -> Column:
    text = value.cast("string")
    marked = F.when(text.startswith("\\"), F.concat(F.lit("\\"), text)).otherwise(text)
    return F.coalesce(marked, F.lit(_NULL))


def _read(text: Column) -> Column:
    marked = F.when(text.startswith("\\"), F.substring(text, 2, 1 << 30)).otherwise(text)
    return F.when(text != _NULL, marked)


def write_tsv(result: DataFrame, path: str) -> None:
    values = result.select(*[_written(F.col(f"`{c}`")).alias(c) for c in result.columns])
    values.write.mode("overwrite").options(**_FORMAT, quoteAll="true").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of ``write_tsv``, of any types that text can be cast to."""
    texts = StructType([StructField(f.name, StringType()) for f in schema.fields])
    rows = (
        spark.read.schema(texts)
        .options(**_FORMAT, multiLine="true", mode="FAILFAST", emptyValue="", nullValue="\0")
        .csv(path)
    )
    return rows.select(*[
        _read(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema.fields
    ])
