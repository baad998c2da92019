"""What the operators share: words, stored tables, row keys, batches, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.workspace import fresh_folder

# Fixed by the data contract: ASCII letters fold to lower case, a word is a run of
# ASCII letters, digits and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SHINGLE_WORDS = 5
SIMILARITY = 0.8
FOLDS = 3
HELD_OUT_FOLD = 1


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It cuts the lineage: what follows reads files that outlive any executor, and
    no expensive step is done again.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of keys that may be sent to every task: about 100 MB.
BROADCAST_KEYS = 1_000_000


def sent_if_small(keys: DataFrame) -> DataFrame:
    """A stored table of keys, to be broadcast if its rows are within the bound.

    Beyond it the join is left to Spark, which shuffles both sides.
    """
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def folded(text: Column) -> Column:
    """Text with ASCII capitals lowered and all else as it was."""
    return F.translate(text, UPPER, UPPER.lower())


def word_array(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.coalesce(
        F.regexp_extract_all(folded(text), F.lit(f"({WORD})"), F.lit(1)),
        F.array().cast("array<string>"),
    )


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % FOLDS == (
        HELD_OUT_FOLD
    )


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; null has a key of its own."""
    return F.struct(
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit("other"), text).alias("b")
    )


#: Bytes of a batch that are turned into Python objects at a time.
PART_BYTES = 2 << 20


def in_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded bytes, of one row at least.

    Workers serve many tasks: at the end of one, unused memory goes back to the system.
    """
    for batch in batches:
        rows = max(1, batch.num_rows * PART_BYTES // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def give_back() -> None:
    """Unused memory of a worker to the system: of Python, of Arrow, of the C library."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def column_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each batch as Python lists."""
    for batch in batches:
        yield [column.to_pylist() for column in batch.columns]


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of equal leading columns in sorted input, one group in memory at a time."""
    current, rows = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            key = row[:keys]
            if key != current:
                if rows:
                    yield current, rows
                current, rows = key, []
            rows.append(row[keys:])
    if rows:
        yield current, rows


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """Connected components of an edge list (a, b): each node with its least node.

    Rounds of taking the least label of all neighbours and then the label of that
    label, so chains shorten by halves. A hub is aggregated before it is shuffled.
    Each round is a written table; only a count of changes reaches the driver.
    An empty edge list has no nodes.
    """
    pairs = stored(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a != b").distinct(),
        f"{purpose}-edges",
    )
    labels = stored(
        pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        .select("node", F.least("node", "low").alias("label")),
        f"{purpose}-labels",
    )
    while True:
        near = (
            pairs.join(labels, pairs["b"] == labels["node"])
            .groupBy("a").agg(F.min("label").alias("low"))
        )
        lowered = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("before"), F.least("label", "low").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = stored(
            lowered.join(jump, "label", "left").select(
                "node", "before", F.least("label", F.coalesce("next", "label")).alias("label")
            ),
            f"{purpose}-labels",
        )
        labels = after.select("node", "label")
        if after.where("before != label").isEmpty():
            return labels
