import re

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import near_duplicates as N
from millrace.llm.common import shingle_hashes, word_hashes
from millrace.llm.near_duplicates import blocks, kept_keys, near_duplicates, op5_near_duplicates, parity_sketch, tables_of

U = np.uint64


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def by_brute_force(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    shared = {}
    for ks in where.values():
        for a in range(len(ks)):
            for b in range(a):
                shared[ks[b], ks[a]] = shared.get((ks[b], ks[a]), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a][1]) + len(sets[b][1]) - n):
            up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i is None, i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets))


@given(st.text(st.sampled_from("abAB \t\n\x0b.é "), max_size=60))
def test_hashes_tell_shingles_apart(text):
    assert len(shingle_hashes(text)) == len(shingles(text))
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    assert len(set(zip(w, word_hashes(text).tolist()))) == len(set(w)) == len(set(word_hashes(text).tolist()))


@given(st.integers(0, 2**32), st.integers(3, 400), st.integers(0, 60), st.integers(0, 60))
def test_similar_sets_keep_a_common_block(seed, both, only_a, only_b):
    rng = np.random.default_rng(seed)
    h = rng.integers(0, 2**64, both + only_a + only_b, U)
    a, b = np.unique(h[: both + only_a]), np.unique(np.append(h[:both], h[both + only_a :]))
    apart = len(np.setxor1d(a, b))
    assert np.bitwise_count(parity_sketch(a, 256) ^ parity_sketch(b, 256)).sum() <= apart
    if 4 * both < 3 * (both + only_a + only_b):
        return
    heavy = np.sort(np.concatenate([blocks(a, t, c)[1] for t, c, _ in tables_of(len(a))])[: rng.integers(0, 50)])
    freq = rng.integers(1, 5, len(heavy))
    kept = [np.concatenate([kept_keys(x, t, c, k, heavy, freq) for t, c, k in tables_of(len(x))]) for x in (a, b)]
    assert len(np.intersect1d(*kept))


def test_against_brute_force(spark):
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in op5_near_duplicates(spark, "/root/testdata/sf0.01").collect())
    assert got == by_brute_force(docs)


def test_chains_passages_and_edges(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    text = list(rng.choice(words, 90))
    docs = []
    for i in range(60):  # each a few words from the last: links in a chain, far apart at its ends
        docs.append((i, " ".join(text)))
        text[rng.integers(0, 90)] = rng.choice(words)
    passage = " ".join(rng.choice(words, 60))
    docs += [(100 + i, " ".join(rng.choice(words, rng.integers(20, 60))) + " " + passage) for i in range(80)]
    docs += [(200, None), (201, ""), (202, " \n"), (203, "One two"), (204, "one  TWO"), (204, "one two"), (205, "one"), (None, "one two"), (206, "a b c d e f g"), (207, "a b c d e f g h"), (208, "b c d e f g"), (None, "zz")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(frame).collect()), key=str)
    assert got == sorted(by_brute_force([d for d in docs if d[0] is not None] + [(None, "one two"), (None, "zz")][:0]) + [(True, None, 1, 203), (True, None, 1, None)], key=str)


def test_hot_bucket_is_dealt_into_bounded_tasks(spark):
    rows = spark.range(400).selectExpr("7L key", "id sid", "10L parts").unionByName(spark.range(3).selectExpr("8L key", "id sid", "1L parts"))
    tasks = {}
    for r in N._dealt(rows).collect():
        tasks.setdefault((r.key, r.i, r.j), []).append((r.sid, r.side))
    met = {}
    for (key, i, j), members in tasks.items():
        assert len(members) <= 140
        for x, s in members:
            for y, t in members:
                if x < y and (i == j or s != t):
                    met[key, x, y] = met.get((key, x, y), 0) + 1
    assert set(met.values()) == {1} and len(met) == 400 * 399 // 2 + 3


def test_shared_passage_below_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET", 8)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    passage = list(rng.choice(words, 50))
    docs = [(i, " ".join([*passage, *rng.choice(words, 10)])) for i in range(120)]  # 46 of 56 shingles in common: no link
    docs += [(200 + i, t.rsplit(" ", 2)[0] + " x y") for i, (_, t) in enumerate(docs[:20])]  # linked with one each
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == by_brute_force(docs)
    assert len({c for _, _, _, c in got}) == 120


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
