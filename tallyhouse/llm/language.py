"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams, in order. A text gets a profile of
its own and the language whose profile is least out of place: for each n-gram of the
text the difference of the two ranks, or the most there is where the language lacks it.

N-grams are 64-bit codes, made for all places of a text at once: up to three characters
they are the characters themselves, longer ones are hashed. They are counted by language
over all the documents learnt from, first in every task, and only profiles, a fixed
number of n-grams for each language, leave the cluster's tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import stored

PROFILE = 400
LONGEST = 5
UNKNOWN = "und"
#: Profiles are sent to every task: 400 n-grams each, so at most 400,000.
MOST_LANGUAGES = 1_000
#: Words that are coded at once, and counted codes a task holds of a language before it
#: adds equal ones up and, if that is still too many, passes them on. No effect on results.
TOGETHER, HELD = 200_000, 1_000_000

_LETTERS = re.compile(r"[^\W\d_]+")
_BLANK = np.uint64(32)
_BITS = np.uint64(21)  # of a code point
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letter_words(text: str) -> list[str]:
    """The runs of letters of a text, lowered."""
    return _LETTERS.findall(text.lower())


def _codes(words: list[str]) -> np.ndarray:
    """Codes of all n-grams of the words, each between blanks, but for the blank alone."""
    text = f" {' '.join(words)} ".encode("utf-32-le", "replace")
    points = np.frombuffer(text, "<u4").astype(np.uint64)
    blank = points == _BLANK
    out = [points[~blank]]
    code, inside = points, np.ones(len(points), bool)
    for n in range(2, LONGEST + 1):
        # Longer by one: the character between the ends must not be a blank.
        last = points[n - 1 :]
        if n > 2:
            inside = inside[: len(last)] & ~blank[n - 2 : n - 2 + len(last)]
        else:
            inside = inside[: len(last)]
        code = code[: len(last)]
        if n > 3:
            code = (code ^ (code >> np.uint64(29))) * _MIX
            code = code + last
            out.append((code ^ np.uint64(n))[inside] | np.uint64(1 << 63))
        else:
            code = (code << _BITS) | last
            out.append(code[inside])
    return np.concatenate(out)


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal codes put together, in ascending order."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], np.add.reduceat(counts, starts)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text in ascending order of code, and their counts."""
    words = letter_words(text)
    parts = [
        np.unique(_codes(words[at : at + TOGETHER]), return_counts=True)
        for at in range(0, len(words), TOGETHER)
    ]
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return _summed(*(np.concatenate(column) for column in zip(*parts, strict=True)))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, gram, n) of a task."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    sizes: dict[str, int] = {}

    def together(lang: str) -> None:
        held[lang] = [_summed(*(np.concatenate(c) for c in zip(*held[lang], strict=True)))]
        sizes[lang] = len(held[lang][0][0])

    def rows(lang: str) -> pa.RecordBatch:
        together(lang)
        codes, counts = held.pop(lang)[0]
        del sizes[lang]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]).take(pa.array(np.zeros(len(codes), np.int32))),
             pa.array(codes.view(np.int64)), pa.array(counts.astype(np.int64))],
            names=["lang", "gram", "n"],
        )

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes, counts = gram_counts(text)
            if not len(codes):
                continue
            held.setdefault(lang, []).append((codes, counts))
            sizes[lang] = sizes.get(lang, 0) + len(codes)
            if sizes[lang] > HELD:
                together(lang)
            if sum(sizes.values()) > 2 * HELD:
                yield rows(max(sizes, key=sizes.get))
    for lang in list(held):
        yield rows(lang)


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang",
                   size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank from 0) of the most frequent n-grams; ties by code.

    Rows without text or language teach nothing.
    """
    taught = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        "lang is not null and text is not null"
    )
    grams = (
        taught.mapInArrow(_counted, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (
        # A filter on the row number itself drops what can't be kept before the shuffle.
        grams.withColumn("nth", F.row_number().over(by_count)).where(F.col("nth") <= size)
        .select("lang", "gram", (F.col("nth") - 1).alias("rank"))
    )


class _Ranker:
    """Out-of-place distances of texts to profiles."""

    def __init__(self, profiles: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        self.langs = sorted({lang for lang, _, _ in profiles})
        codes = np.array([gram for _, gram, _ in profiles], np.int64).view(np.uint64)
        self.known, row = np.unique(codes, return_inverse=True)
        # The last row is of all n-grams that no profile has.
        self.ranks = np.full((len(self.known) + 1, len(self.langs)), -1, np.int64)
        place = {lang: k for k, lang in enumerate(self.langs)}
        for (lang, _, rank), at in zip(profiles, row, strict=True):
            self.ranks[at, place[lang]] = rank

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(text or "")
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        # Codes ascend, so a stable order by count settles ties by code.
        top = codes[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.searchsorted(self.known, top)
        at[at == len(self.known)] = 0
        theirs = self.ranks[np.where(self.known[at] == top, at, len(self.known))]
        apart = np.abs(theirs - np.arange(len(top))[:, None])
        totals = np.where(theirs < 0, self.size, apart).sum(axis=0)
        best = int(np.argmin(totals))
        return self.langs[best], float(1 - totals[best] / (self.size * len(top)))


def identify(
    docs: DataFrame,
    profiles: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = PROFILE,
) -> DataFrame:
    """The language of each row: doc_id, lang_pred, score.

    ``score`` is 1 less the share of the largest possible distance. Null texts and
    texts without letters, and all texts where no profile was learnt, are ``und`` with
    score 0; ties go to the language first in code point order. N-grams of a text that
    tie for a rank are ordered by code. Repeated rows are judged each; other
    columns are not read. More than ``MOST_LANGUAGES`` languages are an error.
    """
    if profiles.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages: profiles are too many to send")
    learnt = [(r["lang"], r["gram"], r["rank"]) for r in profiles.toLocalIterator()]
    ranker = docs.sparkSession.sparkContext.broadcast(_Ranker(learnt, size))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ranker.value
        for batch in batches:
            found = [own(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(judge, "doc_id long, lang_pred string, score double")


def profiles_of(docs: DataFrame) -> DataFrame:
    """Profiles as a small stored table, so that they are learnt once."""
    return stored(learn_profiles(docs), "profiles")
