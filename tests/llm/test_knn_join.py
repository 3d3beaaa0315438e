import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import knn_join as K


def brute(rows, k):
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in ok if i % 10 == 0}):
        q = min(v for j, v in ok if j == i)
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


@pytest.mark.parametrize("per_group,per_slice,pivots", [(2048, 40_000, 1024), (3, 17, 8)])
def test_against_brute_force(spark, monkeypatch, per_group, per_slice, pivots):
    monkeypatch.setattr(K, "QUERIES_PER_GROUP", per_group)
    monkeypatch.setattr(K, "ROWS_PER_SLICE", per_slice)
    monkeypatch.setattr(K, "MAX_PIVOTS", pivots)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 6)) * 4
    rows = [(i, (centres[i % 5] + rng.normal(size=6) * 0.3).tolist()) for i in range(300)]
    rows += [(1000 + i, centres[1].tolist()) for i in range(60)]  # ties
    rows += [(2000, None), (2010, [1.0, None]), (2020, [float("nan")]), (2030, [float("inf"), 1.0]), (None, [1.0]), (2040, []), (2050, [2.0, -1.0])]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, score int")
    got = [tuple(r) for r in K.knn_join(frame, F.col("vec_id") % 10 == 0, k=4).orderBy("query_id", "rank").collect()]
    assert got == brute(rows, 4)


def test_hot_query_id(spark, monkeypatch):
    monkeypatch.setattr(K, "ROWS_PER_SLICE", 50)
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(100, 6)) * 3).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(10, vectors[10])] * 200 + [(20, vectors[3]), (20, [9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in K.knn_join(frame, F.col("vec_id") % 10 == 0, k=4).orderBy("query_id", "rank").collect()]
    assert got == brute(rows, 4)
    _, _, right, _ = next(K.passes(frame, F.col("vec_id") % 10 == 0, 4))
    assert max(r["count"] for r in right.groupBy("g", "slice").count().collect()) < 100


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in K.knn_join(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert K.knn_join(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert K.knn_join(frame.where("vec_id = 1"), F.col("vec_id") == 0).count() == 0


def test_bounds_prune_clustered_vectors(spark):
    """Of 30 clusters a question meets few rows of others; without clusters bounds in many dimensions allow little."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 8))
    centres *= 3 / np.sqrt((centres**2).sum(1, keepdims=True))
    made = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    clustered = made(np.concatenate([c + rng.normal(size=(200, 8)) * 0.05 for c in centres]))
    asks = F.col("vec_id") % 20 == 0
    assert K.sent_share(clustered, asks) < 0.1
    rows = [tuple(r) for r in clustered.collect()]
    got = [tuple(r) for r in K.knn_join(clustered, F.col("vec_id") % 1000 == 0, k=4).orderBy("query_id", "rank").collect()]
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64)
    want = []
    for q in range(0, len(rows), 1000):
        score = x @ x[q]
        order = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:4]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(order)]
    assert got == want
    assert K.sent_share(made(rng.normal(size=(600, 64))), asks) <= 1.5


def test_long_vectors_and_extra_columns(spark):
    rows = [(i, [float(i % 7), 1.0] + [0.5] * (5000 * (i == 3)), 1, 2, 3) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int, dist int, asks int")
    got = [tuple(r) for r in K.knn_join(frame, F.col("vec_id") % 10 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == brute([r[:2] for r in rows], 3)
