import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from millrace.operators import retrieval as R


@pytest.mark.parametrize("per_pass,block", [(131_072, 4096), (131_072, 3), (4, 2)])
def test_blocks_and_passes_make_no_difference(spark, monkeypatch, per_pass, block):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, rng.normal(size=5).tolist()) for i in range(80)] + [(80 + i, 1, [1.0] * 5) for i in range(6)] + [(90, 0, [0.0] * 5)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    queries = vectors.where("vec_id % 8 = 0").selectExpr("vec_id AS query_id", "label AS q_label", "embedding AS q")
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, _, v in rows}
    label = {i: c for i, c, _ in rows}
    score = lambda q, i: round(float(np.clip(unit[q] @ unit[i], 0, 1)), 6)
    asked = [i for i in unit if i % 8 == 0]
    monkeypatch.setattr(R, "QUERIES_PER_PASS", per_pass)
    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    best = {q: sorted((-score(q, i), i) for i in unit if i != q)[:4] for q in asked}
    got = {(r.query_id, r.rank): (r.vec_id, round(r.score, 5)) for r in R.dense_top(vectors, queries, 4).collect()}
    assert got == {(q, k): (i, round(-s, 5)) for q in asked for k, (s, i) in enumerate(best[q], 1)}
    categories = {(r.query_id, r.category): round(r.best, 5) for r in R.dense_categories(vectors, queries).collect()}
    assert categories == {(q, c): round(max(score(q, i) for i in unit if i != q and label[i] == c), 5) for q in asked for c in (0, 1, 2)}


def test_a_product_is_bounded(spark, monkeypatch):
    """However large a batch of vectors, a block of queries meets so many of them at once."""
    seen = []
    monkeypatch.setattr(R, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(R._Nearest, "add", lambda self, batch, s, add=R._Nearest.add: (add(self, batch, s), seen.append(s.shape))[0])
    vectors = spark.createDataFrame([(i, 0, [float(i % 5), 1.0]) for i in range(36)] + [(i, 0, [-1.0, -9.0]) for i in range(36, 50)], "vec_id long, label int, embedding array<double>").coalesce(1)
    queries = vectors.where("vec_id < 3").selectExpr("vec_id AS query_id", "label AS q_label", "embedding AS q")
    held = {}

    class Vectors:  # runs the task here
        sparkSession = spark

        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            held["rows"] = sorted(tuple(x.values()) for b in f(iter(vectors.toArrow().to_batches())) for x in b.to_pylist())
            return vectors

    R._scored(Vectors(), queries, lambda *block: R._Nearest(*block, 4, None), "query_id long, vec_id long, score double")
    assert seen and max(s[1] for s in seen) <= 7
    unit = lambda i: np.array([i % 5, 1.0]) / np.hypot(i % 5, 1) if i < 36 else -np.ones(2)
    want = [(q, i, s) for q in range(3) for s, i in [(-s, i) for s, i in sorted((-round(max(float(unit(q) @ unit(i)), 0.0), 6), i) for i in range(50) if i != q)[:4]]]
    assert held["rows"] == sorted(want)


@pytest.mark.parametrize("same", [None, lambda asked, label: (label == asked) | (label == 0)])
def test_a_task_holds_little_beside_its_questions(spark, same):
    """Four thousand questions and a full batch of vectors, as large inputs give: what numpy holds at once stays small."""
    rng, held = np.random.default_rng(2), {}
    x, label = rng.normal(size=(10_000, 8)), rng.integers(0, 3, 10_000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(label), pa.array(x.tolist())], names=["vec_id", "label", "embedding"])
    queries = spark.createDataFrame(pa.Table.from_batches([batch.slice(0, 4096)])).selectExpr("vec_id AS query_id", "label AS q_label", "embedding AS q")

    class Vectors:  # runs the task here
        sparkSession = spark

        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            tracemalloc.start()
            held["rows"] = pa.Table.from_batches(list(f(iter([batch]))))
            held["most"] = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()

    R._scored(Vectors(), queries, lambda *block: R._Nearest(*block, 5, same), "query_id long, vec_id long, score double")
    assert held["most"] < 200e6
    assert held["rows"].num_rows == 4096 * 5
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = held["rows"].to_pandas().groupby("query_id")
    for q in (0, 1023, 1024, 4095):
        score = np.round(np.clip(unit @ unit[q], 0, 1), 6)
        fits = [i for i in range(10_000) if i != q and (same is None or same(label[q], label[i]))]
        assert sorted(got.get_group(q)["vec_id"]) == sorted(sorted(fits, key=lambda i: (-score[i], i))[:5])
