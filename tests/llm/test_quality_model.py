import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from millrace.llm.quality_model import ORDER, most_frequent, op6_quality_model, perplexities, quality

TEXTS = ["the cat sat on the mat. the hat", "a cat and a rat sat", "that is that, the end", "on and on and on the mat", "rats"]


def model(texts):
    """p(w | h) by the textbook."""
    grams = Counter()
    for t in texts:
        x = "\2" * (ORDER - 1) + t + "\3"
        grams.update(x[i : i + ORDER] for i in range(len(x) - ORDER + 1))
    of = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        of[k] = Counter(g[1:] for g in of[k + 1])
    stats = {}
    for k, c in of.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = []
        for j in (1, 2, 3):
            raw = j - (j + 1) * y * n[j + 1] / n[j] if n[1] and n[j] else -1
            d.append(raw if 0 < raw < j else j / 2)
        total, mass = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            mass[g[:-1]] += d[min(v, 3) - 1]
        stats[k] = (c, d, total, mass)

    def p(h, w):
        k = len(h) + 1
        c, d, total, mass = stats[k]
        below = p(h[1:], w) if k > 1 else 1 / (len(of[1]) + 1)
        if h not in total:
            return below
        v = c[h + w]
        return (max(0, v - d[min(v, 3) - 1]) if v else 0) / total[h] + mass[h] / total[h] * below

    return p


@pytest.mark.parametrize("head", [10**6, 40, 0])
def test_by_the_textbook(spark, head):
    p = model(TEXTS)
    asked = [*TEXTS, "the zebra sat", "", None, "q", "tttt", "on a mat"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(asked)] + [(99, "the cat", "fr")], "_row long, text string, _lang string")
    trusted = spark.createDataFrame([(t, "en") for t in TEXTS], "text string, lang string")
    got = {r._row: r.perplexity for r in perplexities(docs, trusted, head).collect()}
    assert got[99] is None and got[6] is None and got[7] is None
    for i, t in enumerate(asked):
        if t:
            x = "\2" * (ORDER - 1) + t + "\3"
            s = sum(math.log(p(x[k : k + ORDER - 1], x[k + ORDER - 1])) for k in range(len(x) - ORDER + 1))
            assert got[i] == pytest.approx(math.exp(-s / (len(t) + 1)), rel=1e-4)


def test_four_characters_of_context(spark):
    trusted = spark.createDataFrame([("1aaa2", "en"), ("3aaa4", "en")] * 3, "text string, lang string")
    docs = spark.createDataFrame([(0, "1aaa2", "en"), (1, "1aaa4", "en")], "_row long, text string, _lang string")
    got = {r._row: r.perplexity for r in perplexities(docs, trusted).collect()}
    assert got[1] > 1.1 * got[0]


def test_verdicts(spark):
    labels = dict((i, q) for i, q in duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    rows = op6_quality_model(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.4


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "text", None), (None, "text", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        assert sorted((str(r.doc_id), r.kept) for r in quality(docs, some).collect()) == [("1", False), ("2", False), ("2", True), ("None", True)]
    assert quality(docs.limit(0), labels).count() == 0


def test_extra_columns_and_long_texts(spark):
    names = ["g", "n", "v", "h", "lang2", "_n", "_tail", "_sum", "perplexity"]
    docs = spark.createDataFrame([(1, "the cat " * 40_000, "en", *names), (2, "the cat sat", "en", *names)], ["doc_id", "text", "lang", *names])
    labels = spark.createDataFrame([(2, 1, "x")], "doc_id long, quality int, lang string")
    assert sorted((r.doc_id, r.kept) for r in quality(docs, labels).collect()) == [(1, True), (2, True)]


def test_the_most_frequent(spark):
    rows = spark.createDataFrame([(c,) for c in (5, 4, 4, 3, 1, 1)], "c long")
    got = lambda n: sorted(r.c for r in most_frequent(rows, n).collect())
    assert got(4) == [3, 4, 4, 5] and got(2) == [5] and got(0) == [] and len(got(10)) == 6
