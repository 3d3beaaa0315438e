import duckdb
import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm.language_id import CrossParser, _plain, identify, op7_language_id, samples

SF = "/root/testdata/sf0.01"


def phrases_by_search(text, sample):
    n = i = 0
    while i < len(text):
        k = i + 1
        while k < len(text) and text[i : k + 1] in sample:
            k += 1
        i, n = k, n + 1
    return n


@given(st.text("abc", min_size=1, max_size=40), st.lists(st.text("abcd ", max_size=60), max_size=5))
def test_phrases_by_substring_search(sample, texts):
    parser = CrossParser({"x": sample, "y": "bca"})
    plain = [_plain(t) for t in texts]
    got = parser.phrases(plain)
    for p, row in zip(plain, got):
        t = bytes(p)
        assert row.tolist() == [phrases_by_search(t, bytes(_plain(s))) for s in (sample, "bca")]


@given(st.text("abc ", min_size=1, max_size=30), st.lists(st.text("abcd ", max_size=90), max_size=5), st.integers(1, 9))
def test_stretches_make_no_difference(sample, texts, stretch):
    parser = CrossParser({"x": sample, "y": "bca ab"})
    plain = [_plain(t) for t in texts]
    assert parser.phrases(plain, stretch).tolist() == parser.phrases(plain, 1000).tolist()


def test_long_texts():
    rng = np.random.default_rng(3)
    sample = "".join(rng.choice(list("ab c"), 500))
    texts = ["".join(rng.choice(list("ab cd"), n)) for n in (5000, 1024, 1025, 3)] + [sample * 20, "ab c" * 700, "a" * 3000]
    parser = CrossParser({"x": sample})
    got = parser.phrases([_plain(t) for t in texts])[:, 0].tolist()
    assert got == [phrases_by_search(bytes(_plain(t)), bytes(_plain(sample))) for t in texts]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "123 !", "q"), (3, "hello hello", "q"), (None, "日本", "q"), (4, "½²①Ⅷ", "q"), (5, "hello " * 30_000, "q")], "doc_id long, text string, score string")
    rows = identify(docs, {"en": "hello world", "fr": "bonjour"})
    got = rows.collect()
    assert rows.columns == ["doc_id", "lang_pred", "score"]
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "fr"), (1, "und"), (2, "und"), (3, "en"), (3, "und"), (4, "und"), (5, "en")]
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in identify(docs.select("doc_id", "text"), {}).collect()] == ["und"] * 7
    assert identify(docs.limit(0), {"en": "hello"}).count() == 0
    assert samples(spark.createDataFrame([], "text string, lang string")) == {}


def test_samples_are_whole_texts_within_the_bounds(spark):
    header = "lorem ipsum " * 100
    rows = [(f"{header}{i} " + "der hund und die katze " * 40, "de") for i in range(30)] + [("short", "en"), ("short", "en"), ("", "en"), (None, "en"), ("x", None), ("y" * 60_000, "fr"), ("z " * 9000, "it")]
    frame = spark.createDataFrame(rows, "text string, lang string")
    got = samples(frame)
    assert set(got["de"].split("\n")) <= {t for t, _ in rows} and got["de"].count("\n") + 1 == 40_000 // len(rows[0][0]) and got["en"] == "short"
    assert got["it"] == "z " * 9000 and "fr" not in got
    assert set(samples(frame, languages=2)) == {"de", "it"} and samples(frame, docs=2)["de"].count("\n") == 1


def test_held_out_accuracy(spark):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    rows = op7_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    right = [lang[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    assert len(right) > 150 and np.mean(right) > 0.97
