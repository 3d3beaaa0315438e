import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import common
from millrace.llm.packing import WordEncoder, best_fit_decreasing, lower_bound, packed, pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER = WordEncoder(PATH)
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdehinorst'vmlESÀéßÿ0123.,#|\n\t "), st.characters(codec="utf-8")), max_size=200))
def test_encodes_as_the_library(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == ids(text)


@pytest.mark.parametrize("text", ["", "a" * 500, "<|endoftext|> x", "Don'tREE's x²ª", "İΣ\x85\xa0", "I'LL 12's"])
def test_edge_texts(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == ids(text)


@given(st.lists(st.integers(1, 99), max_size=60))
def test_bins_hold_and_bound_bounds(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offset, used = best_fit_decreasing(lengths, 100)
    assert (used <= 100).all() and lower_bound(lengths, 100) <= len(used)
    for b in range(len(used)):
        at = sorted((offset[i], lengths[i]) for i in np.flatnonzero(bins == b))
        assert [o for o, _ in at] == np.cumsum([0, *[n for _, n in at]])[:-1].tolist()


def test_bound_is_tight_for_large_pieces():
    assert lower_bound(np.array([51] * 7), 100) == 7
    assert lower_bound(np.array([34] * 7), 100) == 4


@pytest.mark.parametrize("per", [5, 1000])
def test_packs_every_id_once(spark, per):
    texts = ["word " * n for n in (0, 1, 3, 9, 30, 31, 70, 200)] + ["The END, 1 2 3.", None] * 9
    docs = spark.createDataFrame([(i % 20, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, bin int")
    rows = packed(common.cut(pieces(docs, PATH, 64)), 64, per_partition=per).collect()
    want = sorted((i % 20, k, s, len(w[s : s + 64]), zlib.crc32(np.array(w[s : s + 64], "<u4").tobytes())) for i, t in enumerate(texts) for w in [[*ids(t), 0]] for k, s in enumerate(range(0, len(w), 64)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *[n for _, n in b]])[:-1].tolist() and sum(n for _, n in b) <= 64
    if per == 1000:
        assert len(bins) <= lower_bound(np.array([r.length for r in rows]), 64) + 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packed(common.cut(pieces(docs, PATH))).count() == 0


@pytest.mark.parametrize("per", [3, 1000])
def test_null_and_large_ids(spark, per):
    big = 1 << 60
    rows = [(big + 1, "a b c"), (big + 3, "a b c"), (None, "a b c"), (None, None), (-big - 1, "x " * 200), (big + 1, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packed(common.cut(pieces(docs, PATH, 64)), 64, per_partition=per).collect()
    want = sorted(((i, len(w[s : s + 64])) for i, t in rows for w in [[*ids(t), 0]] for s in range(0, len(w), 64)), key=repr)
    assert sorted(((r.doc_id, r.length) for r in got), key=repr) == want
