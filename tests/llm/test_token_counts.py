import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.merging import Merger
from millrace.llm.token_counts import PieceCounter, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
COUNTER = PieceCounter(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdehinorst ETA.,\n\t é▁<s>0"), st.characters(codec="utf-8")), max_size=400))
def test_counts_as_the_library(text):
    assert COUNTER.counts([text]) == [len(LIBRARY.encode(text))]


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, "the" * 900 + "\n\n", "<s> hi </s><unk>", "日本語 text ▁▁ x", "    indent\t\ttab", "e" * 193 + " é" * 70, "thethethatthanthen" * 400, "日本国憲法は" * 900, "=-" * 2500 + "x", "ab" * 5000 + "abc", "iiiillllii" * 600])
def test_edge_texts(text):
    assert COUNTER.counts([text, None]) == [len(LIBRARY.encode(text)), 0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["th", "e", "er", "ing", "ation", "in", "on", "a", "an", "the", "x", "0", "00", "=", "--", "日", "é"]), max_size=300))
def test_unspaced_texts_as_the_library(parts):
    text = "".join(parts)
    assert COUNTER.counts([text]) == [len(LIBRARY.encode(text))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=14), st.lists(st.lists(st.integers(0, 2), max_size=120), max_size=4))
def test_rounds_as_one_merge_after_the_other(made, sequences):
    """Any table of merges, ranks in any order: symbols 0 to 2 and what earlier pairs made."""
    pairs, width, ranks = {}, {0: 1, 1: 1, 2: 1}, list(range(len(made)))
    ranks = ranks[::2] + ranks[1::2][::-1]
    for k, (a, b) in enumerate(made):
        if a in width and b in width and (a, b) not in pairs and width[a] + width[b] <= 6:
            pairs[a, b] = (ranks[k], len(width))
            width[len(width)] = width[a] + width[b]
    if pairs:
        m = Merger(pairs, 6)
        assert [x.tolist() for x in m.run(sequences)] == [m.one(s) for s in sequences]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "hello wörld", "x"), (1, "hello wörld", "y"), (None, None, None)], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts(docs, PATH).collect())
    n = len(LIBRARY.encode("hello wörld"))
    assert got == [(0, 0, 0), (1, 12, n), (1, 12, n)]
    assert token_counts(docs.limit(0), PATH).count() == 0
