import duckdb
import numpy as np

from millrace.llm import toxicity
from millrace.llm.toxicity import Model, fit, objective, op3_toxicity, scored, train

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    rows = op3_toxicity(spark, SF).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    hits = sum(t and p for t, p in held)
    assert hits / sum(t for t, _ in held) > 0.85 and hits / sum(p for _, p in held) > 0.9


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "bad word"), (None, "bad")], "doc_id long, text string")
    none = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int")
    assert [r.score < 1e-9 for r in scored(docs, train(docs, none)).collect()] == [True] * 4
    assert train(docs.limit(0), none.limit(0)).intercept == -40
    model = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    assert [r.score for r in scored(docs, model).collect()] == [0.5] * 4


def test_an_id_with_most_rows_leaves_the_sample_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda words, p, u, prior: seen.append((len(p), len(u))))
    docs = [(7, f"hot w{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)] + [(100 + i, f"cold x{chr(97 + i)}") for i in range(20)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, 1), (100, 0)], "doc_id long, toxic int")
    train(docs, labels, positives=5, unlabelled=30)
    train(docs, labels, positives=5, unlabelled=21)
    assert seen == [(5, 30), (5, 21)]


def test_learns_a_word_from_few_examples(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.integers(0, 400, 30)) + (" Vile!" if i % 10 == 0 else "")) for i in range(600)]
    labels = [(i, int(i % 10 == 0)) for i in range(300)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = scored(docs, train(docs, labels)).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 10 == 0) for r in got)


def test_extra_columns_empty_tables_and_long_texts(spark):
    model = Model(np.sort(toxicity.features("vile")), np.full(len(toxicity.features("vile")), 9.0), -5.0)
    docs = spark.createDataFrame([(1, "fine " * 60_000 + "vile", 7, 8, 9), (2, "fine", 7, 8, 9)], "doc_id long, text string, score int, words int, toxic int")
    rows = scored(docs, model)
    assert rows.columns == ["doc_id", "words", "toxic", "score"]
    assert [(r.doc_id, r.words, r.score > 0.5) for r in rows.orderBy("doc_id").collect()] == [(1, 8, True), (2, 8, False)]
    assert scored(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1, "x")], "doc_id long, toxic int, text string")
    assert 0 <= scored(docs, train(docs, labels)).first().score <= 1


def test_slopes_by_finite_differences():
    """In both branches: the corrected risk, and the way back where its corrected part is negative."""
    rng = np.random.default_rng(2)
    seen = set()
    for shift in (-3, 0, 3):
        g = rng.normal(size=30)
        g[:12] += 2 * shift
        g[12:] -= shift
        logistic = lambda x: np.log1p(np.exp(-x))
        rest = lambda x: logistic(-x[12:]).mean() - 0.3 * logistic(-x[:12]).mean()
        back = rest(g) < 0
        risk = (lambda x: -rest(x)) if back else (lambda x: 0.3 * logistic(x[:12]).mean() + rest(x))
        value, slope = objective(g, 12, 0.3)
        steps = np.eye(30) * 1e-6
        assert abs(value - risk(g)) < 1e-12 and np.allclose(slope, [(risk(g + s) - risk(g - s)) / 2e-6 for s in steps], atol=1e-7)
        seen.add(back)
    assert seen == {False, True}


def test_fit_finds_the_least_risk():
    """Against plain gradient descent on the dense matrix."""
    rng = np.random.default_rng(4)
    x = (rng.random((300, 6)) < np.where(np.arange(300)[:, None] < 60, 0.6, 0.3) * np.linspace(1.5, 0.5, 6)).astype(float)
    model = fit(np.arange(6, dtype=np.uint64), [np.flatnonzero(r) for r in x[:60]], [np.flatnonzero(r) for r in x[60:]], 0.25, steps=3000, rate=0.01)

    def risk(w):
        g = x @ w[:6] + w[6]
        rest = np.logaddexp(0, g[60:]).mean() - 0.25 * np.logaddexp(0, g[:60]).mean()
        return 0.25 * np.logaddexp(0, -g[:60]).mean() + max(0, rest) + 0.5e-3 * (w[:6] ** 2).sum()

    w = np.append(np.zeros(6), np.log(1 / 3))
    for _ in range(20_000):
        _, slope = objective(x @ w[:6] + w[6], 60, 0.25)
        w -= 0.3 * (np.append(x.T @ slope, slope.sum()) + 1e-3 * np.append(w[:6], 0))
    assert abs(risk(np.append(model.weights, model.intercept)) - risk(w)) < 2e-3


def test_words_are_chosen_by_their_share_of_documents(spark):
    rows = [(int(i % 3 == 0), np.array(sorted({1, 2 + i % 5, *([9] if i % 3 == 0 else [10])}), np.uint64).tobytes()) for i in range(300)]
    assert toxicity.select_words(spark.createDataFrame(rows, "toxic int, words binary").repartition(3)).tolist() == [9, 10]
