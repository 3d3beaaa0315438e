import hashlib
import math
import random
import re
import zlib
from collections import Counter

from millrace.llm.resampling import ranked, resampled


def features(text, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) for n in range(1, most + 1) for k in range(len(w) - n + 1)]


def brute(docs, target, most, buckets, min_words, percent, seed):
    """Sorted (doc_id, n_features, weight, score, rank), from strings."""
    s, t = (Counter(x % buckets for text in texts for x in features(text, most)[1]) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for i, text in docs:
        n, f = features(text, most)
        weight = sum(math.floor(1000 * math.log((t[x % buckets] + 1) * T**-1 * S / (s[x % buckets] + 1))) for x in f)
        h = None if i is None else int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, n, len(f), weight, score))
    order = sorted((r for r in rows if r[1] >= min_words and r[0] is not None), key=lambda r: (-r[4], r[0], r[2]))
    k = percent * len(order) // 100
    out = [(*r[:1], *r[2:], place if place <= k else None) for place, r in enumerate(order, 1)]
    return sorted(out + [(*r[:1], *r[2:], None) for r in rows if r[1] < min_words or r[0] is None], key=repr)


def corpus():
    r = random.Random(3)
    some = "alpha beta GAMMA delta épsilon 语言 z9 one two three".split()
    docs = [(i, " ".join(r.choices(some, k=r.randrange(0, 60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "..!?"), (None, "alpha " * 30), (203, "x" * 90 + " y" * 5000), (7, docs[7][1]), (8, docs[9][1])]
    return docs, [" ".join(r.choices(some[:4], k=30)) for _ in range(9)] + [None, ""]


def test_against_brute_force(spark):
    docs, target = corpus()
    frame = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, weight int, _n_words string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for most, buckets, percent in ((1, 10_000, 10), (3, 97, 35)):
        got = ranked(frame, aim, most, buckets, 20, percent, 11).collect()
        want = brute(docs, target, most, buckets, 20, percent, 11)
        assert sorted((tuple(r) for r in got), key=repr) == want
        drawn = resampled(frame, aim, most, buckets, 20, percent, 11)
        assert drawn.columns == frame.columns and sorted(r.doc_id for r in drawn.collect()) == sorted(w[0] for w in want if w[4])


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a " * 25)], "doc_id long, text string")
    assert ranked(frame.limit(0), frame).collect() == [] and resampled(frame.limit(0), frame).collect() == []
    assert [r.rank for r in ranked(frame, frame.limit(0), percent=100).collect()] == [1]


def test_draws_follow_the_target(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choices(("good fine" if i % 4 == 0 else "bad poor").split(), k=40))) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    drawn = [x.doc_id for x in resampled(frame, spark.createDataFrame([("good fine " * 20,)], "text string"), percent=20).collect()]
    assert len(drawn) == 80 and all(i % 4 == 0 for i in drawn)
