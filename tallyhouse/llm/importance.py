"""Target-distribution importance resampling on hashed word runs.

An untrained Split of the tokenizers library cuts the ASCII-lowered text into words with
offsets. Pairs of offsets give the runs of one to three words; the crc32 of a run names one
of a fixed number of buckets. Buckets are counted in every task before they are added up,
so what reaches the driver is one number a bucket, whatever the corpus. A bucket's gain
is how much more often the target has it, and a document's weight the sum of its gains.
Gumbel noise from a hash of the id turns the weights into draws without replacement: the
highest scores are drawn.

The words are split once: the buckets of a document are stored, two bytes each, and read
again for the sum. Ranks come from a range partitioning by score: rows are numbered within
their partition and partitions by their counts, so no task sorts more than its share.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex
from tokenizers.pre_tokenizers import Split

from tallyhouse.llm.common import WORD, stored

# Fixed by the data contract.
BUCKETS = 10_000
LONGEST_RUN = 3
SCALE = 1_000
SEED = 42
LEAST_WORDS = 20
DRAWN, OF = 5, 100

#: Buckets are stored in two bytes.
MOST_BUCKETS = 1 << 16
#: Rows that one task sorts for their ranks.
RANKED_PER_TASK = 1_000_000

_SEPARATORS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_HASHED = "doc_id long, n_words long, n_features long, buckets binary"
_CHUNK_BYTES = 16 << 20


@functools.cache
def _splitter() -> Split:
    return Split(Regex(WORD), behavior="removed", invert=True)


def word_offsets(flat: bytes) -> list[tuple[int, int]]:
    """Byte offsets of the words of a text."""
    text = PreTokenizedString(flat.decode())
    _splitter().pre_tokenize(text)
    return [at for _, at, _ in text.get_splits("original", "byte")]


def run_buckets(text: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every run of up to ``longest`` words.

    Words are first brought one space apart, so that the bytes between two offsets are
    the run as it is hashed. The crc32 of a run goes on from that of the run before its
    last word.
    """
    flat = _SEPARATORS.sub(b" ", text.lower()).strip()
    at = word_offsets(flat)
    if not at:
        return 0, np.empty(0, np.uint16)
    ends = [stop for _, stop in at]
    added = [flat[i:j] for i, j in pairwise(ends)]
    runs = hashes = [crc32(flat[i:j]) for i, j in at]
    for more in range(longest - 1):
        runs = list(map(crc32, added[more:], runs))
        hashes = hashes + runs
    return len(at), (np.array(hashes, np.uint32) % buckets).astype(np.uint16)


def _hashed(longest: int, buckets: int) -> Callable:
    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, words, parts, held = 0, [], [], 0
            texts = batch.column(1).cast(pa.binary())
            for row in range(batch.num_rows + 1):
                if row == batch.num_rows or held > _CHUNK_BYTES:
                    yield _rows(batch.column(0).slice(start, row - start), words, parts)
                    start, words, parts, held = row, [], [], 0
                if row < batch.num_rows:
                    n, part = run_buckets(texts[row].as_py() or b"", longest, buckets)
                    words.append(n)
                    parts.append(part)
                    held += part.nbytes

    return hashed


def _rows(ids: pa.Array, words: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(words, pa.int64()), pa.array(map(len, parts), pa.int64()),
         pa.array([part.tobytes() for part in parts], pa.binary())],
        names=["doc_id", "n_words", "n_features", "buckets"],
    )


def hashed_runs(
    docs: DataFrame, doc_id: str | None, text: str,
    longest: int = LONGEST_RUN, buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, n_words, n_features and the bucket of each run, two bytes each, by row."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}")
    own = F.lit(None) if doc_id is None else F.col(doc_id)
    read = docs.select(own.cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(_hashed(longest, buckets), _HASHED)


def _flat(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch, and where each row's begin and the last ends."""
    parts = [value.as_buffer() for value in batch.column(column)]
    lengths = np.array([part.size // 2 for part in parts], np.int64)
    flat = np.concatenate([np.empty(0, np.uint16), *(np.frombuffer(p, np.uint16) for p in parts)])
    return flat, np.concatenate(([0], np.cumsum(lengths)))


def _counts(buckets: int) -> Callable:
    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            n += np.bincount(_flat(batch, 0)[0], minlength=buckets)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())], names=["bucket", "n"]
        )

    return counts


def histogram(hashed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """How many runs fall in each bucket (bucket, n); each task counts its own first."""
    per_task = hashed.select("buckets").mapInArrow(_counts(buckets), "bucket int, n long")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket, from the histograms of corpus and target."""
    n = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    whole, aimed = (
        h.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for h in (corpus, target)
    )
    both = (
        n.join(corpus.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .na.fill(0, ["s", "t"])
    )
    above = (F.col("t").cast("double") + 1) * (F.lit(float(whole)) + buckets)
    below = (F.col("s").cast("double") + 1) * (F.lit(float(aimed)) + buckets)
    gain = F.floor(F.lit(float(SCALE)) * F.log(above / below)).alias("gain")
    # One number a bucket, at most MOST_BUCKETS.
    return [row["gain"] for row in both.select("bucket", gain).orderBy("bucket").collect()]


def _weights(gain: list[int]) -> Callable:
    def weights(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.array(gain, np.int64)
        for batch in batches:
            flat, at = _flat(batch, 3)
            sums = np.concatenate(([0], np.cumsum(of[flat])))[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(sums), pa.int64())],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return weights


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document, in thousandths, from a hash of its id."""
    own = F.coalesce(doc_id.cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), own).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, drawn: int, of: int) -> DataFrame:
    """Numbers the ``drawn``-of-``of`` share of rows with the highest scores, from 1.

    The rank column of the others is null. Ties go to the smaller id, null last; rows alike
    in both are numbered in any order.
    """
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, rows.count() // RANKED_PER_TASK + 1)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Stored, since a row's place must not change once it is counted.
    placed = stored(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()),
        "importance-order",
    ).withColumn("part", F.shiftright("at", 33))
    counts = sorted(placed.groupBy("part").count().collect())  # one row a partition
    before, upto = [], 0
    for part, n in counts:
        before.append((part, upto))
        upto += n
    starts = spark.createDataFrame(before or [(0, 0)], "part long, before long")
    nth = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    rank = F.when(nth <= drawn * upto // of, nth).alias("rank")
    return placed.join(F.broadcast(starts), "part").select(*rows.columns, rank)


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    drawn: int = DRAWN,
    of: int = OF,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Weight, score and rank of every row of ``docs`` for resembling ``target``.

    Returns doc_id, n_words, n_features, weight, score and rank. Rows of at least
    ``least_words`` words take part in the draw; ``drawn`` of ``of`` of them get a rank,
    1 for the highest score, ties to the smaller id (null last); all others a null. A null
    or empty text has no features and weight 0. Repeated rows count as often as they stand
    and are ranked each. An empty ``docs`` gives no rows; an empty ``target`` counts
    nothing, which leaves smoothing. Other columns are not read.
    """
    hashed = stored(hashed_runs(docs, doc_id, text), "importance-runs")
    gain = gains(
        stored(histogram(hashed), "importance-corpus"),
        stored(histogram(hashed_runs(target, None, target_text)), "importance-target"),
    )
    scored = stored(
        hashed.mapInArrow(_weights(gain), "doc_id long, n_words long, n_features long, weight long")
        .withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)),
        "importance-scores",
    )
    takes_part = F.col("n_words") >= least_words
    out = scored.where(~takes_part).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(takes_part), drawn, of).unionByName(out)
