"""Operator 9."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import knn, queries
from tests.conftest import DATA


def test_op9(spark, same_rows):
    same_rows(queries.op9_knn(spark, DATA), queries.oracle_sql()["op9_knn"])


def brute(rows, top):
    out = []
    valid = [(i, [np.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in valid:
        if q % 100 == 0:
            best = sorted({(-max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b)))), i) for i, b in valid if i != q and len(a) == len(b)})[:top]
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("pivots", [1, 16])
def test_ties_clusters_and_blocks(spark, monkeypatch, pivots):
    monkeypatch.setattr(knn, "BLOCK", 30)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(700):
        centre = rng.normal(0, 1, 4) if i % 3 else np.ones(4)  # a third of all rows are one vector
        rows.append((i, [float(x) for x in centre]))
    found = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, pivots=pivots)
    assert sorted(map(tuple, found.collect())) == brute(rows, 10)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, []), (6, [1.0]), (200, [2.0]), (300, [1.0, 2.0, 3.0]), (400, [inf, 1.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    assert sorted(map(tuple, knn.top_k(frame, F.col("vec_id") % 100 == 0).collect())) == brute(rows, 10)
    assert knn.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_large_integers_are_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 5.0]])
    assert knn.products(a, b)[0, 0] == 2**60 + 15


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("pivots", [1, 3, None])
def test_large_vectors_and_rows_without_id(spark, kind, pivots):
    """All finite vectors take part, however large; scores beyond 64 bits are the largest or smallest that fit."""
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 2.0]), (100, [1e5, -3e5]), (200, [3e38, -1e38]), (300, [-2e18, 5.0]), (400, [-1.0, 0.0])]
    rows += [(1, [3e38, 1.0]), (2, [-2e5, 2e5]), (None, [1.0, 1.0]), (3, [0.5, 0.25]), (4, [4e5, 0.0]), (5, [1e17, 1e17]), (6, [1e17, -1e17]), (7, [-3e38, -3e38])]
    rows += [(k, [float(np.float32(x)) for x in rng.normal(0, 10.0 ** rng.integers(0, 12), 2)]) for k in range(500, 540)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    assert sorted(map(tuple, knn.top_k(frame, F.col("vec_id") % 100 == 0, pivots=pivots).collect())) == brute(rows, 10)


def test_a_large_candidate_ranks_first(spark):
    rows = [(0, [1.0] + [0.0] * 63), (1, [4e5] + [0.0] * 63), *[(k, [k / 100] + [0.5] * 63) for k in range(2, 30)]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert knn.top_k(frame, F.col("vec_id") == 0).where("rank = 1").first()["score"] == 419_430_400_000


def test_products_of_mixed_sizes():
    v = np.array([[1.0, -2.0], [2.0**30, 2.0**31], [2.0**60, -(2.0**60)], [2.0**200, 1.0]])
    q = np.array([[3.0, 5.0], [2.0**31, 7.0], [-(2.0**100), 0.0]])
    exact = [[max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x, y)))) for y in q] for x in v]
    assert knn.products(v, q).tolist() == exact


def test_cells_that_are_left_out_hold_no_better_vector():
    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 100, (500, 3))
    centres = vectors[:20]
    cell = ((vectors[:, None] - centres) ** 2).sum(2).argmin(1)
    dist = np.sqrt(((vectors - centres[cell]) ** 2).sum(1))
    close = np.full((20, 11), np.inf)
    for c in range(20):
        d = np.sort(dist[cell == c])[:11]
        close[c, : len(d)] = d
    radius = np.array([dist[cell == c].max(initial=0) for c in range(20)])
    seen = knn.reach(vectors[:40], centres, radius, 11, close)
    assert not seen.all()
    for q in range(40):
        assert all(seen[q, cell[i]] for i in np.argsort(-(vectors @ vectors[q]))[:11])
