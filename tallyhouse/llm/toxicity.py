"""Toxicity by a linear classifier with a counterfactual penalty.

Features are the words of a text and their beginnings, present or not; Spark counts how
many labelled documents of either label, all outside the held-out fold, have each, and
those that tell the labels apart best are kept. The weights are fitted on a bounded sample
of the labelled rows, and on further rows for each kept feature that the sample has too
rarely; these are chosen by features alone, so they do not tilt what a logistic model
learns. For each sampled sentence that names a group a copy names another group instead,
and the squared change of its score is added to the loss: names can't carry a score, and a
neutral text that mentions a group is not marked for it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import held_out, in_parts, sent_if_small, stored, text_key

# Names of groups that are swapped for one another.
IDENTITY_TERMS = (
    "women", "men", "girls", "boys", "gay", "lesbian", "straight", "transgender", "black",
    "white", "asian", "african", "european", "american", "mexican", "indian", "chinese",
    "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian",
    "jewish", "hindu", "buddhist", "immigrants", "refugees", "disabled", "deaf", "blind",
    "old", "young", "poor", "rich",
)

#: Lengths of word beginnings that are features of their own.
BEGINNINGS = range(3, 9)
#: Features kept, the fewest documents one must be in, and the least chi-square.
VOCABULARY, LEAST_DOCS, LEAST_CHI2 = 5_000, 3, 6.0
#: Most labelled rows the weights are fitted on, those with the least hashed ids, besides
#: up to LEAST_DOCS documents for each feature that fewer of them have. Two numbers each,
#: they are sent to every task, so the texts need not be shuffled.
SAMPLE = 50_000
THRESHOLD = 0.7
ROUNDS, RATE, RIDGE = 300, 0.1, 1e-5
#: Weight of the squared change under a swap of names.
COUNTERFACTUAL = 10.0
#: Features a task counts before it passes the counts on. No effect on results.
HELD, REMEMBERED = 50_000, 30_000

_WORDS = re.compile(r"[^\W_]+")
_SENTENCES = re.compile(r"[.!?\n]+")


def words_of(text: str) -> set[str]:
    return set(_WORDS.findall(text.lower()))


def features_of(words: Iterable[str]) -> set[str]:
    """Words, and their beginnings with a star."""
    found = set(words)
    for word in list(found):
        for n in BEGINNINGS:
            if len(word) <= n:
                break
            found.add(word[:n] + "*")
    return found


def swapped(words: list[str], terms: tuple[str, ...]) -> list[str]:
    """The words with each name of a group replaced by the next one of the list."""
    after = dict(zip(terms, (*terms[1:], *terms[:1]), strict=True))
    return [after.get(word, word) for word in words]


def _distinct_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its distinct words, spaced: what of a text may have to be shuffled."""
    for batch in in_parts(batches):
        words = [" ".join(words_of(text or "")) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words, pa.string())], names=["doc_id", "words"]
        )


def _feature_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by feature, all and toxic ones; the empty feature is in each."""
    docs, toxic = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        names = list(docs)
        out = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([docs[n] for n in names], pa.int64()),
             pa.array([toxic[n] for n in names], pa.int64())],
            names=["feature", "docs", "toxic"],
        )
        docs.clear()
        toxic.clear()
        return out

    for batch in in_parts(batches):
        for label, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = features_of(words.split())
            found.add("")
            docs.update(found)
            if label:
                toxic.update(found)
            if len(docs) > HELD:
                yield flush()
    yield flush()


def _holders(features: set[str]):
    """Per feature the LEAST_DOCS documents of a task that have it and the least ranks."""

    def hold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, list[tuple[int, int]]] = {}
        for batch in in_parts(batches):
            for rank, of, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for feature in features_of(words.split()) & features:
                    held = least.setdefault(feature, [])
                    if (rank, of) not in held:
                        held.append((rank, of))
                        held.sort()
                        del held[LEAST_DOCS:]
        rows = [(feature, *one) for feature, held in least.items() for one in held]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.int64())],
            names=["feature", "rank", "of"],
        )

    return hold


def _sparse(place: dict[str, int], terms: tuple[str, ...]):
    """Per sampled document its features, and those of sentences that name groups and copies."""
    named = set(terms)

    def ids(words: Iterable[str]) -> list[int]:
        return sorted(place[f] for f in features_of(words) if f in place)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            features, pairs = [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text or "")
                features.append(ids(words))
                pairs.append([
                    [ids(s), ids(swapped(s, terms))] for part in _SENTENCES.split(text or "")
                    if named & set(s := _WORDS.findall(part.lower()))
                ] if named & words else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(features, pa.list_(pa.int32())),
                 pa.array(pairs, pa.list_(pa.list_(pa.list_(pa.int32()))))],
                names=["place", "toxic", "features", "pairs"],
            )

    return read


@dataclass
class Model:
    """Weights by feature; ``bias`` alone scores a text without features."""

    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[str, ...]] = {}

    def score(self, text: str | None) -> float:
        known, found = self.known, set()
        for word in words_of(text or ""):
            if (own := known.get(word)) is None:
                if len(known) > REMEMBERED:
                    known.clear()
                own = known[word] = tuple(
                    sorted(f for f in features_of([word]) if f in self.weights)
                )
            found.update(own)
        total = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


class _Rows:
    """Sparse rows of present features."""

    def __init__(self, rows: list[np.ndarray], signs: list[np.ndarray] | None = None) -> None:
        self.n = len(rows)
        self.col = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.sign = np.concatenate(signs) if signs else np.ones(len(self.col))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col] * self.sign, minlength=self.n)

    def turned(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, weights=r[self.row] * self.sign, minlength=width)


def fit(
    rows: list[tuple[int, list[int], list[tuple[list[int], list[int]]]]],
    vocabulary: list[str],
    penalty: float = COUNTERFACTUAL,
) -> Model:
    """Weights from (toxic, features, [(features of a sentence, of its copy)]) of a sample."""
    width = len(vocabulary)
    labels = np.array([r[0] for r in rows], float)
    seen = _Rows([np.array(r[1], np.int64) for r in rows])
    apart, signs = [], []
    for _, _, pairs in rows:
        for mine, other in pairs:
            gone, new = sorted(set(mine) - set(other)), sorted(set(other) - set(mine))
            if gone or new:
                apart.append(np.array(gone + new, np.int64))
                signs.append(np.array([1.0] * len(gone) + [-1.0] * len(new)))
    swaps = _Rows(apart, signs)
    weights, bias = np.zeros(width), 0.0
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for turn in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-np.clip(seen.dot(weights) + bias, -500, 500)))
        off = (p - labels) / max(1, len(rows))
        grad = seen.turned(off, width) + RIDGE * weights
        if swaps.n:
            change = 2 * penalty * swaps.dot(weights) / swaps.n
            grad += swaps.turned(change, width)
        grad = np.append(grad, off.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        step = RATE * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    return Model(dict(zip(vocabulary, weights.tolist(), strict=True)), float(bias))


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
    terms: tuple[str, ...] = IDENTITY_TERMS,
) -> Model:
    """A model from the labelled documents outside the held-out fold.

    All of them are counted for the vocabulary; the weights are fitted on at most ``sample``
    and the ones added for rare features. Rows without id or label teach nothing. Without labelled rows the model scores
    everything 0.5; a document labelled twice counts twice.
    """
    known = labels.select(F.col(doc_id).alias("of"), F.col(label).alias("toxic")).where(
        F.col("of").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("of"))
    )
    known = stored(known, "labelled")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    labelled = (
        texts.mapInArrow(_distinct_words, f"doc_id {texts.schema['doc_id'].dataType.simpleString()},"
                                          " words string")
        .join(sent_if_small(known), F.col("doc_id") == F.col("of"))
    )
    counts = stored(
        labelled.select(F.col("toxic").cast("int").alias("toxic"), "words")
        .mapInArrow(_feature_counts, "feature string, docs long, toxic long")
        .groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
        .where((F.col("docs") >= LEAST_DOCS) | (F.col("feature") == "")),
        "feature-counts",
    )
    totals = counts.where("feature = ''").first()
    if not totals:
        return Model({}, 0.0)
    share = totals["toxic"] / totals["docs"]
    if share in (0.0, 1.0):
        return Model({}, -5.0 if share == 0 else 5.0)
    expected = F.col("docs") * share
    chi2 = (F.col("toxic") - expected) ** 2 / (expected * (1 - share))
    kept = (
        counts.where("feature != ''").withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
        .orderBy(F.desc("chi2"), "feature").limit(VOCABULARY)
    )
    vocabulary = sorted(r["feature"] for r in kept.select("feature").collect())
    place = {feature: k for k, feature in enumerate(vocabulary)}

    def rows_of(chosen: DataFrame) -> list[tuple]:
        found = (
            texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
            .select(F.xxhash64("doc_id", "text").alias("place"),
                    F.col("toxic").cast("int").alias("toxic"), "text")
            .mapInArrow(_sparse(place, terms), "place long, toxic int, features array<int>,"
                                               " pairs array<array<array<int>>>")
            .orderBy("place").limit(sample).collect()
        )
        return [(r["toxic"], r["features"], r["pairs"]) for r in found]

    rank = F.xxhash64("of")
    chosen = stored(known.orderBy(rank, "of", "toxic").limit(sample), "sampled")
    rows = rows_of(chosen)
    seen = Counter(k for _, features, _ in rows for k in features)
    if rare := {feature for feature, k in place.items() if seen[k] < LEAST_DOCS}:
        holders = (
            labelled.select(rank.alias("rank"), F.col("of").cast("long").alias("of"), "words")
            .mapInArrow(_holders(rare), "feature string, rank long, of long")
            .groupBy("feature").agg(F.array_sort(F.collect_set(F.struct("rank", "of"))).alias("least"))
            .select(F.explode(F.slice("least", 1, LEAST_DOCS)["of"]).alias("of")).distinct()
        )
        added = stored(
            known.join(F.broadcast(holders), "of", "left_semi")
            .join(F.broadcast(chosen.select("of").distinct()), "of", "left_anti"),
            "sampled-for-rare",
        )
        rows += rows_of(added)
    return fit(rows, vocabulary)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The toxicity of each row: doc_id, key (of the text), score.

    Null and empty texts score as a text without features. Repeated rows are scored
    each; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in in_parts(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([own.score(t) for t in batch.column(2).to_pylist()], pa.float64())],
                names=["doc_id", "key", "score"],
            )

    chosen = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"),
        F.col(text).alias("text"),
    )
    return chosen.mapInArrow(judge, "doc_id long, key struct<a: long, b: long>, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold: one pass, no join."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in in_parts(batches):
            scores = [own.score(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
