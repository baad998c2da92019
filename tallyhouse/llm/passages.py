"""Substring deduplication by hashing lines, or passages that begin and end anywhere.

A unit is a line (``without_repeats``) or a run of words between cut words
(``without_repeated_passages``). Its digest is taken of its words, so that case, white
space and punctuation make no difference. Of the units with one digest, anywhere in the
corpus, the one in the first document, and there the first, is kept; the others are cut
out and the offsets of what stays are told. The first place of each digest is found by a
partial minimum in every task, so a unit in a third of all documents is one row a task.

Lines leave passages that repeat inside lines which differ elsewhere. Cut words do not:
they are chosen by the words around them alone, so that two texts with a passage in
common are cut alike within it, wherever it stands in them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import UPPER, WORD, in_parts, stored, text_key
from tallyhouse.llm.ngram_join import words_of

#: Shorter lines are kept wherever they stand: they repeat by chance.
LEAST_WORDS = 5

#: A word is a cut if it has the least hash of some run of this many words, the last such
#: word of the run where several tie. A passage keeps at most one word less at either end.
CUT_WINDOW = 12
#: A unit reaches from a cut to the second one after it.
GAPS = 2
#: Passages of 50 words are found whatever stands around them: within one, units cover all
#: but 11 words at either end. Runs of repeated units that cover fewer words stay.
LEAST_PASSAGE = 50
LEAST_COVERED = LEAST_PASSAGE - 2 * (CUT_WINDOW - 1)

_UNITS = "doc_id long, key struct<a: long, b: long>, start int, stop int, digest binary"


def line_spans(text: str) -> Iterator[tuple[int, int]]:
    """Offsets of the lines of a text, ends exclusive and without the line end."""
    start = 0
    while True:
        stop = text.find("\n", start)
        if stop < 0:
            yield start, len(text)
            return
        yield start, stop
        start = stop + 1


def _units(least_words: int):
    def units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, starts, stops, digests = [], [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                for start, stop in line_spans(text or ""):
                    words = words_of(text[start:stop]) if text else []
                    if len(words) >= least_words:
                        of.append(row)
                        starts.append(start)
                        stops.append(stop)
                        digests.append(
                            hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                        )
            at = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int32()),
                 pa.array(stops, pa.int32()), pa.array(digests, pa.binary())],
                names=["doc_id", "key", "start", "stop", "digest"],
            )

    return units


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the removed lines, and the offsets of what was kept and removed."""
    for batch in batches:
        texts, lines, counts, kept_at, gone_at = [], [], [], [], []
        for text, removed in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            gone = set(removed or ())
            spans = list(line_spans(text or ""))
            kept = [span for span in spans if span[0] not in gone]
            texts.append("\n".join((text or "")[a:b] for a, b in kept))
            lines.append(len(spans))
            counts.append(len(spans) - len(kept))
            kept_at.append(",".join(f"{a}:{b}" for a, b in kept))
            gone_at.append(",".join(f"{a}:{b}" for a, b in spans if a in gone))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()),
             pa.array(counts, pa.int64()), pa.array(kept_at, pa.string()),
             pa.array(gone_at, pa.string())],
            names=["doc_id", "text", "n_units", "n_removed", "kept", "removed"],
        )


def without_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Each row of ``docs`` without the lines that stand earlier in the corpus.

    Returns doc_id, text (what is kept, lines joined as they were), n_units (lines),
    n_removed, kept and removed (``start:end`` in code points of the original text,
    ends exclusive, joined by commas). Documents are ranked by id, null last, then by
    text; within a document the first line counts. Lines of fewer than ``least_words``
    words stay. A null text is an empty one, of one empty line; repeated rows are the
    same document twice: both keep the lines that it keeps. An empty table gives no
    rows. Other columns are not read.
    """
    keyed = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"),
        F.col(text).alias("text"),
    )
    units = stored(keyed.mapInArrow(_units(least_words), _UNITS), "units")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "start")
    # Stored, so that both sides of the join are shuffled for it alone and Spark can split
    # the rows of a line that stands in very many documents.
    firsts = stored(
        units.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "first"),
        "first-places",
    )
    removed = (
        units.join(firsts, "digest").where(place != F.col("first"))
        .groupBy(F.struct("doc_id", "key").alias("of"))
        .agg(F.collect_set("start").alias("starts"))
    )
    own = F.struct("doc_id", "key")
    return (
        keyed.join(removed, own.eqNullSafe(removed["of"]), "left")
        .select("doc_id", "text", "starts")
        .mapInArrow(_cut, "doc_id long, text string, n_units long, n_removed long,"
                          " kept string, removed string")
    )


class _CutHashes(dict):
    """The first 32 bits of the MD5 digest of a word, which SQL has too."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = int.from_bytes(
            hashlib.md5(word, usedforsecurity=False).digest()[:4], "big"
        )
        return code


def cuts(codes: np.ndarray, window: int = CUT_WINDOW) -> np.ndarray:
    """Indexes of the cut words, ascending, with 0 and the number of words as the ends."""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64)
    # The place in the low half, counted from the end, makes the last of equal hashes least.
    keys = (codes << np.uint64(32)) | np.arange(n, 0, -1, dtype=np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(keys, min(window, n)).min(axis=1)
    chosen = n - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return np.unique(np.concatenate([chosen, [0, n]]))


def _passage_units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units as places in words and digests; the memory of words lasts for one part."""
    for batch in in_parts(batches):
        of, starts, stops, digests = [], [], [], []
        known = _CutHashes()
        for row, text in enumerate(batch.column(2).to_pylist()):
            words = words_of(text or "")
            at = cuts(np.array([known[word] for word in words], np.uint64)).tolist()
            for start, stop in zip(at, at[GAPS:], strict=False):
                of.append(row)
                starts.append(start)
                stops.append(stop)
                digests.append(int.from_bytes(
                    hashlib.blake2b(b" ".join(words[start:stop]), digest_size=8).digest(),
                    "big", signed=True,
                ))
        at = pa.array(of, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int32()),
             pa.array(stops, pa.int32()), pa.array(digests, pa.int64())],
            names=["doc_id", "key", "start", "stop", "digest"],
        )


def covered(units: Iterable[tuple[int, int]], least: int = LEAST_COVERED) -> list[list[int]]:
    """Maximal runs of words that units cover, of ``least`` words or more, in order."""
    merged: list[list[int]] = []
    for start, stop in sorted(units):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    return [run for run in merged if run[1] - run[0] >= least]


_WORD = re.compile(WORD)
_LOWER = str.maketrans(UPPER, UPPER.lower())


def _cut_passages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the covered runs, and the offsets of what was kept and removed."""
    for batch in in_parts(batches):
        texts, words, spans, kept_at, gone_at = [], [], [], [], []
        for text, units in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            text = text or ""
            gone = covered((unit["start"], unit["stop"]) for unit in units or ())
            n_gone = sum(stop - start for start, stop in gone)
            # A run goes with all that follows it up to the next word.
            at = [m.start() for m in _WORD.finditer(text.translate(_LOWER))] if gone else []
            edges = [(at[a] if a else 0, at[b] if b < len(at) else len(text)) for a, b in gone]
            inner = [0, *(edge for pair in edges for edge in pair), len(text)]
            kept = [(a, b) for a, b in zip(inner[::2], inner[1::2], strict=True) if a < b]
            texts.append("".join(text[a:b] for a, b in kept))
            words.append(n_gone)
            spans.append(len(gone))
            kept_at.append(",".join(f"{a}:{b}" for a, b in kept))
            gone_at.append(",".join(f"{a}:{b}" for a, b in edges))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.int64()),
             pa.array(words, pa.int64()), pa.array(kept_at, pa.string()),
             pa.array(gone_at, pa.string())],
            names=["doc_id", "text", "n_spans", "n_removed", "kept", "removed"],
        )


def without_repeated_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Each row of ``docs`` without the passages that stand earlier in the corpus.

    Returns doc_id, text (what is kept, joined), n_spans (removed runs), n_removed (their
    words), kept and removed (``start:end`` in code points of the original text, ends
    exclusive, joined by commas). A removed run goes with the blanks and marks after it.
    Every passage of ``LEAST_PASSAGE`` words that stands earlier, in this document or
    another, is removed but for ``CUT_WINDOW - 1`` words at either end, and for its first
    place; texts that are copies as a whole are removed whole. Nothing of fewer than
    ``LEAST_COVERED`` words is. Documents are ranked by id, null last, then by text. A null
    text is an empty one; repeated rows are the same document twice: both keep what it
    keeps. An empty table gives no rows. Other columns are not read.

    Digests have 64 bits: a removal rests on two units or more, hence on two equalities.
    """
    keyed = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("key"),
        F.col(text).alias("text"),
    )
    units = stored(
        keyed.mapInArrow(
            _passage_units, "doc_id long, key long, start int, stop int, digest long"
        ),
        "units",
    )
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "start")
    firsts = stored(
        units.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "first"),
        "first-places",
    )
    own = F.struct("doc_id", "key")
    removed = (
        units.join(firsts, "digest").where(place != F.col("first"))
        .groupBy(own.alias("of"))
        .agg(F.collect_set(F.struct("start", "stop")).alias("units"))
    )
    return (
        keyed.join(removed, own.eqNullSafe(removed["of"]), "left")
        .select("doc_id", "text", "units")
        .mapInArrow(_cut_passages, "doc_id long, text string, n_spans long, n_removed long,"
                                   " kept string, removed string")
    )
