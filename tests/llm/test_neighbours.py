"""Nearest vectors against brute force."""

import numpy as np
import pytest

from doclake.llm import neighbours


def brute(ids, rows, query_ids, queries, k):
    out = {}
    for q, vector in zip(query_ids, queries):
        scores = [(-float((vector * row).sum()), int(i)) for i, row in zip(ids, rows) if i != q]
        out[int(q)] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(900, 8)) * rng.uniform(0.2, 3, (900, 1))
    rows[200:500] = rows[200]  # a third are copies
    return np.arange(900), rows.astype(np.float32).astype(np.float64)


def frame(spark, ids, rows):
    data = [(int(i), [float(x) for x in r], 0, "x") for i, r in zip(ids, rows)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int, score string")


def lists(found):
    out = {}
    for row in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert row.rank == len(out[row.query_id])
    return out


@pytest.mark.parametrize("broadcast_bytes", [neighbours.BROADCAST_BYTES, 0])
def test_exact_at_factor_one(spark, data, broadcast_bytes):
    ids, rows = data
    vectors = frame(spark, ids, rows)
    got = lists(neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20, 1.0, 150, 20, broadcast_bytes))
    want = brute(ids, rows, ids[::20], rows[::20], 20)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}
    for q, near in got.items():
        assert np.allclose([s for _, s in near], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_relaxed_recall(spark, data):
    ids, rows = data
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    vectors = frame(spark, ids, rows)
    got = lists(neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), shard_rows=300))
    want = brute(ids, rows, ids[::20], rows[::20], 20)
    hits = sum(s >= want[q][-1][1] - 1e-6 for q, near in got.items() for _, s in near)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_rows_that_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0]),
        (20, [0.5, 0.5]),
        (1, None),
        (2, []),
        (3, [0.0, 0.0]),
        (4, [1.0, None]),
        (5, [float("nan"), 1.0]),
        (40, [float("inf"), 1.0]),
        (60, [1.0, 2.0, 3.0]),
        (None, [1.0, 1.0]),
        (7, [0.0, -1.0]),
        (20, [0.5, 0.5]),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = lists(neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0")))
    assert got == {0: [(20, 0.5), (20, 0.5), (7, 0.0)], 20: [(0, 0.5), (7, -0.5)]}
    assert neighbours.nearest(vectors.where("false"), vectors).count() == 0


@pytest.mark.parametrize("mix", ["one long vector", "mixed norms", "long queries"])
def test_relaxed_recall_does_not_hang_on_the_norms(spark, mix):
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(1500, 16))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    if mix == "one long vector":
        rows[7] *= 30
    if mix == "mixed norms":
        rows *= rng.lognormal(0, 1, (1500, 1))
    ids, asked = np.arange(1500), rows[::20] * (30 if mix == "long queries" else 1)
    rows, asked = (x.astype(np.float32).astype(np.float64) for x in (rows, asked))
    got = lists(neighbours.nearest(frame(spark, ids, rows), frame(spark, ids[::20], asked), shard_rows=200))
    want = brute(ids, rows, ids[::20], asked, 20)
    hits = sum(s >= want[q][-1][1] - 1e-6 for q, near in got.items() for _, s in near)
    assert hits >= 0.9 * sum(map(len, want.values()))
