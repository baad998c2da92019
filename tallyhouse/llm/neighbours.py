"""Nearest neighbours by cosine, with a vantage-point tree in each shard.

Vectors are dealt to shards by hash; a shard's tree is built by the task that holds it
and stored as one row. Vectors of length one have a Euclidean distance that falls as
their cosine rises, so the triangle inequality tells which side of a vantage point can
still hold a nearer vector. Slices of queries meet every shard and go through its tree in
blocks; each keeps its best of a shard, and the best of all shards remain.

The side away from a query is skipped where the inequality, relaxed by a factor, rules
it out: at 1 nothing nearer can be missed, above 1 more is skipped.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import runs, stored

K = 5
RELAX = 1.05
#: Distinct vectors of a shard, queries that one copy of its tree is sent for, queries
#: that go through it together, vectors of a leaf.
SHARD, SLICE, QUERIES, LEAF = 20_000, 16_384, 1_024, 512


class Tree:
    """A vantage-point tree over the rows of a matrix.

    Rows are put in tree order, so that a leaf is a range of them. A node is a leaf,
    (start, end), or (vantage row, radius, inside, outside).
    """

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF) -> None:
        self.leaf, self.order = leaf, []
        units = _units(vectors)
        self.root = self._grown(units, np.arange(len(units)))
        self.order = np.array(self.order, np.int64)
        single = vectors.astype(np.float32)
        # What came as floats is kept as floats.
        self.vectors = (single if (single == vectors).all() else vectors)[self.order]

    def _grown(self, units: np.ndarray, rows: np.ndarray) -> tuple:
        start = len(self.order)
        if len(rows) > self.leaf:
            # The row farthest from the first one sees the others at the most distances.
            far = np.argmin(units[rows] @ units[rows[0]])
            vantage, rest = rows[far], np.delete(rows, far)
            apart = _distances(units[rest], units[vantage])
            radius = float(np.median(apart))
            inside = apart <= radius
            if not inside.all():
                self.order.append(vantage)
                return (start, radius, self._grown(units, rest[inside]),
                        self._grown(units, rest[~inside]))
        self.order.extend(rows)
        return start, len(self.order)

    def ready(self) -> Tree:
        """The tree with its unit vectors, which are not stored."""
        self.vectors = self.vectors.astype(np.float64)
        self.units = _units(self.vectors)
        return self

    def nearest(self, queries: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, int]:
        """Places in tree order of the k nearest of each unit query, -1 where there are
        fewer, and how many distances to rows of leaves were computed."""
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), -1)
        compared = 0

        def offer(who: np.ndarray, start: int, end: int) -> None:
            squares = np.maximum(0, 2 - 2 * (queries[who] @ self.units[start:end].T))
            bound = best[who, -1]
            # Few queries find anything nearer once the first leaves are done.
            better = np.flatnonzero(squares.min(axis=1) < bound * bound)
            if not len(better):
                return
            who, squares = who[better], squares[better]
            if end - start > k:
                near = np.argpartition(squares, k - 1, axis=1)[:, :k]
            else:
                near = np.broadcast_to(np.arange(end - start), squares.shape)
            apart = np.sqrt(np.take_along_axis(squares, near, axis=1))
            both = np.concatenate([best[who], apart], axis=1)
            names = np.concatenate([found[who], near + start], axis=1)
            first = np.argsort(both, axis=1, kind="stable")[:, :k]
            best[who] = np.take_along_axis(both, first, axis=1)
            found[who] = np.take_along_axis(names, first, axis=1)

        def visit(node: tuple, who: np.ndarray) -> None:
            nonlocal compared
            if not len(who):
                return
            if len(node) == 2:
                for start in range(*node, self.leaf):
                    end = min(node[1], start + self.leaf)
                    compared += len(who) * (end - start)
                    offer(who, start, end)
                return
            vantage, radius, inside, outside = node
            apart = _distances(queries[who], self.units[vantage])
            offer(who, vantage, vantage + 1)
            within = apart <= radius
            visit(inside, who[within])
            visit(outside, who[~within])
            # Rounding must not rule out what the inequality lets stand.
            reach = np.abs(apart - radius) * relax <= best[who, -1] + 1e-9
            visit(outside, who[within & reach])
            visit(inside, who[~within & reach])

        visit(self.root, np.arange(len(queries)))
        return found, compared


def _distances(units: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (units @ point)))


def _units(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision, the same for equal rows wherever they stand."""
    scale = np.abs(a).max(axis=1), np.abs(b).max(axis=1)
    a, b = a / scale[0][:, None], b / scale[1][:, None]
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the vectors that are not null, empty or zero and wholly finite."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite
        & F.exists("v", lambda x: x != 0)
    )


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per shard and width of vectors: its tree with vectors, and ids."""
    for (shard, width), rows in runs(batches, 2):
        tree = Tree(np.array([r[0] for r in rows], np.float64))
        packed = pickle.dumps((tree, [rows[at][1] for at in tree.order]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([width], pa.int32()),
             pa.array([packed], pa.binary())],
            names=["shard", "width", "tree"],
        )


def _asked(
    batches: Iterable[pa.RecordBatch],
) -> Iterator[tuple[Tree, list[list[int]], list[tuple[int, list[float]]]]]:
    """Tree, ids and a block of queries; a tree's row comes before its queries."""
    packed, tree, ids = None, None, []
    block: list[tuple[int, list[float]]] = []
    for batch in batches:
        for query_id, q, its_tree in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if its_tree is not None:
                if block:
                    yield tree, ids, block
                packed, block = its_tree, []
                continue
            if packed is not None:
                tree, ids = pickle.loads(packed)
                tree.ready()
                packed = None
            block.append((query_id, q))
            if len(block) == QUERIES:
                yield tree, ids, block
                block = []
    if block:
        yield tree, ids, block


def _search(k: int, relax: float):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, ids, asked in _asked(batches):
            queries = np.array([q for _, q in asked], np.float64)
            # One more than k: a query's own vector may be among them.
            found, _ = tree.nearest(_units(queries), k + 1, relax)
            who, nth = np.nonzero(found >= 0)
            rows_of = found[who, nth]
            scores = cosines(queries[who], tree.vectors[rows_of])
            out: dict[int, list[tuple[float, int]]] = {}
            for q, row, value in zip(who.tolist(), rows_of.tolist(), scores.tolist(), strict=True):
                out.setdefault(q, []).extend(
                    (-value, name) for name in ids[row] if name != asked[q][0]
                )
            kept = [(asked[q][0], name, -value)
                    for q, near in out.items() for value, name in sorted(near)[:k]]
            columns = zip(*kept, strict=True) if kept else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(
                    columns, [pa.int64(), pa.int64(), pa.float64()], strict=True)],
                names=["query_id", "vec_id", "score"],
            )

    return search


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    relax: float = RELAX,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The k nearest found for each row of ``queries``: query_id, rank, vec_id, score.

    Vectors that are null, empty or zero, or hold null or non-finite components, take
    no part, nor do rows without id; vectors of another width than the query's are no
    candidates. Ties go to the smaller vec_id. A row's own id is never its neighbour.
    Equal vectors are one entry of a tree with their k + 1 least ids, which is all a
    query can need of them, so a vector that a third of the rows share takes one place.
    Rows repeated in both id and vector are one. No vectors or no queries give no rows.
    """
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    distinct = (
        usable(vectors, vec_id, embedding)
        .withColumn("nth", F.dense_rank().over(by_vector)).where(F.col("nth") <= k + 1)
        .groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    )
    entries = stored(distinct, "vectors")
    shards = max(1, -(-entries.count() // SHARD))
    trees = stored(
        entries.select(
            F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"),
            F.size("v").alias("width"), "v", "ids",
        )
        .repartition(shards, "shard").sortWithinPartitions("shard", "width", "v")
        .mapInArrow(_build, "shard int, width int, tree binary"),
        "trees",
    )
    asked = stored(usable(queries, vec_id, embedding).distinct(), "asked")
    slices = max(1, -(-asked.count() // SLICE))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    kept = trees.select("shard", every, "width", "tree")
    put = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("slice"),
        F.size("v").alias("width"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"),
    ).join(trees.select("shard", "width"), ["shard", "width"], "left_semi")
    met = kept.unionByName(put, allowMissingColumns=True)
    found = (
        met.repartition("shard", "slice", "width")
        .sortWithinPartitions("shard", "slice", "width", F.col("tree").isNull(), "query_id")
        .select("query_id", "q", "tree")
        .mapInArrow(_search(k, relax), "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
