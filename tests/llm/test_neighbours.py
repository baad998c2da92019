"""Neighbours against brute force: exact at factor one, recall beyond it."""

import numpy as np
import pytest

from tallyhouse.llm import neighbours

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, asked, k=5):
    good = [(i, np.array(v, float)) for i, v in dict(rows).items()
            if v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for i, q in good:
        if asked(i):
            near = sorted((-(q @ v) / np.sqrt((q @ q) * (v @ v)), j)
                          for j, v in good if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near[:k])]
    return sorted(out)


def found(spark, rows, **options):
    vectors = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as rank", "2 as shard")
    queries = vectors.where("vec_id % 7 = 0")
    return sorted(tuple(r) for r in
                  neighbours.nearest_neighbours(vectors, queries, **options).collect())


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


@pytest.fixture
def rows():
    made = np.random.default_rng(5)
    centres = made.normal(size=(12, 8))
    return [(k, (centres[k % 12] + 0.4 * made.normal(size=8)).astype(np.float32).tolist())
            for k in range(900)]


@pytest.mark.parametrize("shard, share", [(20_000, 16_384), (100, 16)])
def test_factor_one_is_exact(spark, rows, monkeypatch, shard, share):
    monkeypatch.setattr(neighbours, "SHARD", shard)
    monkeypatch.setattr(neighbours, "SLICE", share)
    same(found(spark, rows, relax=1.0), brute(rows, lambda i: i % 7 == 0))


def test_small_leaves_are_exact_too(rows):
    units = neighbours._units(np.array([r[1] for r in rows], float))
    tree = neighbours.Tree(units, leaf=4).ready()
    got, compared = tree.nearest(units[:50], 6, 1.0)
    want = np.argsort(-(units[:50] @ units.T), axis=1)[:, :6]
    assert (np.sort(tree.order[got], axis=1) == np.sort(want, axis=1)).all()
    assert compared < 50 * len(rows)


def test_a_tree_meets_its_queries_in_blocks(rows, monkeypatch):
    """Two trees, the first with three blocks and the second without a query, in two batches."""
    import pickle

    import pyarrow as pa

    monkeypatch.setattr(neighbours, "QUERIES", 20)
    vectors = np.array([r[1] for r in rows], float)
    packed = [pickle.dumps((neighbours.Tree(v), v.shape)) for v in (vectors, vectors[:7])]
    batch = pa.record_batch({
        "query_id": pa.array([None, *range(50), None], pa.int64()),
        "q": pa.array([None, *vectors[:50].tolist(), None], pa.list_(pa.float64())),
        "tree": pa.array([packed[0], *[None] * 50, packed[1]], pa.binary()),
    })
    got = list(neighbours._asked([batch.slice(0, 30), batch.slice(30)]))
    assert [len(block) for *_, block in got] == [20, 20, 10]
    assert {ids for _, ids, _ in got} == {vectors.shape}
    assert [i for *_, block in got for i, _ in block] == list(range(50))


def test_recall_of_the_production_factor(spark, rows):
    want = {w[:1] + w[2:3] for w in brute(rows, lambda i: i % 7 == 0)}
    got = {g[:1] + g[2:3] for g in found(spark, rows)}
    assert len(want & got) >= 0.95 * len(want)


def test_ties_copies_and_unusable_vectors(spark):
    rows = [(k, [1.0, 0.0]) for k in range(30)] + [(k, [0.0, 1.0]) for k in range(30, 34)]
    rows += [(35, None), (42, []), (49, [0.0, 0.0]), (56, [float("nan"), 1.0]),
             (63, [float("inf"), 1.0]), (70, [None, 1.0]), (77, [1.0, 1.0, 1.0])]
    same(found(spark, rows), brute(rows, lambda i: i % 7 == 0))


def test_repeated_rows_few_candidates_and_none(spark):
    same(found(spark, [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [2.0, 1.0])]),
         brute([(0, [1.0, 2.0]), (1, [2.0, 1.0])], lambda i: i % 7 == 0))
    assert found(spark, []) == []
