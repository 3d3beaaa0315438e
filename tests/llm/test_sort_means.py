import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.sort_means import MOST, nearest, sort_means


def plain(rows, k, rounds, dims, scale, seed):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        where = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, where) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, assign())), key=repr), centroids


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9), st.integers(0, 60), st.integers(0, 2**32))
def test_nearest_is_exact(k, n, seed):
    rng = np.random.default_rng(seed)
    v, c = rng.integers(-3, 4, (n, 3)), rng.integers(-3, 4, (k, 3))
    cluster, dist, computed = nearest(v, rng.integers(0, k, n), c)
    every = ((v[:, None] - c[None]) ** 2).sum(2)
    assert cluster.tolist() == every.argmin(1).tolist() and dist.tolist() == every.min(1).tolist() and computed <= n * k


def test_far_centroids_are_left_out():
    rng = np.random.default_rng(0)
    centres = rng.integers(-1000, 1000, (32, 8))
    home = rng.integers(0, 32, 4000)
    _, _, computed = nearest(centres[home] + rng.integers(-20, 21, (4000, 8)), home, centres)
    assert computed < 4000 * 32 * 0.1


@pytest.mark.parametrize("k,rounds", [(5, 3), (1, 1), (40, 2), (400, 1)])
def test_against_plain_k_means(spark, k, rounds):
    rng = np.random.default_rng(k)
    rows = [(i, (rng.normal(size=4) + i % 3 * 2).tolist()) for i in range(120)]
    rows += [(200 + i, rows[1][1]) for i in range(30)] + [(3, rows[3][1]), (3, rows[4][1])]  # ties and repeated rows
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0, None, 1.0, 1.0]), (304, [float("nan")] * 4), (305, [float("inf")] * 4), (None, [0.5] * 4), (None, [0.25] * 4)]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got, centroids = sort_means(frame, k, rounds, 4, 16, 9)
    want, expected = plain(rows, k, rounds, 4, 16, 9)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and centroids.tolist() == expected


def test_empty_and_too_large(spark):
    frame = spark.createDataFrame([(1, [float(MOST)] * 4)], "vec_id long, embedding array<double>")
    assert sort_means(frame.limit(0), dims=4)[0].collect() == []
    with pytest.raises(Exception, match="beyond"):
        sort_means(frame, dims=4)
