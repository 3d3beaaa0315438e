from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm.source_mix import Pattern, capped_shares, mix, mixed_documents, op10_source_mix, route


@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_shares_add_up_and_stay_below_the_cap(sizes):
    named = [(f"s{i}", n) for i, n in enumerate(sizes)]
    weights = {f"s{i}": 1 + i % 3 for i in range(len(sizes))}
    got = capped_shares(named, weights, 3)
    assert abs(sum(got.values()) - sum(sizes)) < 1e-6 * max(1, sum(sizes))
    assert all(got[s] <= 3 * n + 1e-6 for s, n in named)
    open_ = [got[s] / weights[s] for s, n in named if got[s] < 3 * n - 1e-6]
    assert not open_ or max(open_) - min(open_) < 1e-6 * max(1, max(open_))


SHAPES = st.lists(st.tuples(st.sets(st.sampled_from("abc"), min_size=1), st.integers(1, 9), st.lists(st.integers(1, 30), min_size=3, max_size=3)), max_size=5)


def least_cost(patterns, quota):
    """Largest flow and its least cost: cheapest paths, one token at a time."""
    level = lambda used, per: 0 if used < per else 1 + next(k for k in range(64) if used < per * 2 ** (k + 1))
    flow, into = [Counter() for _ in patterns], Counter()
    total = 0
    while True:
        # States: a source that wants a token more; from a source to another through a pattern that gives to it.
        best = None
        for i, p in enumerate(patterns):
            used = sum(flow[i].values())
            if used >= sum(p.most.values()):
                continue
            price, seen, queue = level(used, p.round), {("p", i): None}, [("p", i)]
            while queue:
                kind, x = queue.pop(0)
                if kind == "p":
                    nexts = [("s", s) for s in patterns[x].members if flow[x][s] < patterns[x].most[s]]
                else:
                    if into[x] < quota.get(x, 0):
                        if best is None or price < best[0]:
                            best = (price, seen, (kind, x))
                        break
                    nexts = [("p", j) for j in range(len(patterns)) if flow[j][x] > 0]
                for n in nexts:
                    if n not in seen:
                        seen[n] = (kind, x)
                        queue.append(n)
        if best is None:
            return sum(into.values()), total
        price, seen, node = best
        total += price
        into[node[1]] += 1
        while seen[node] is not None:
            before = seen[node]
            if node[0] == "s":
                flow[before[1]][node[1]] += 1
            else:
                flow[node[1]][before[1]] -= 1
            node = before


@settings(deadline=None, max_examples=60)
@given(SHAPES, st.dictionaries(st.sampled_from("abc"), st.integers(0, 60)))
def test_flow_is_largest_and_cheapest(shapes, quota):
    patterns = [Pattern(tuple(sorted(m)), n, dict(zip(sorted(m), caps))) for m, n, caps in shapes]
    flows = route(patterns, quota)
    into = Counter()
    for p, f in zip(patterns, flows):
        assert set(f) == set(p.members) and all(0 <= f[s] <= p.most[s] for s in f)
        into.update(f)
    assert all(into[s] <= quota.get(s, 0) for s in into)
    price = lambda p, used: sum(next(k for k in range(64) if t < p.round * 2**k) for t in range(used))
    largest, cheapest = least_cost(patterns, quota)
    assert sum(into.values()) == largest
    assert sum(price(p, sum(f.values())) for p, f in zip(patterns, flows)) == cheapest


def by_source(rows, m):
    taken = Counter()
    for r in rows:
        taken[r.source] += r[m.copies] * r[m.size]
        assert r[m.copies] <= 3 and (r[m.size] > 0 or r[m.copies] == 0)
    return taken


def test_nulls_ties_and_overlap(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 40)), f"s{i % 4}", 1) for i in range(400)] + [(500, None, "s0", 1), (501, "", None, 1), (7, "w w w", "s3", 1), (None, "w w", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int")
    m = mix(docs)
    assert m.size == "__size"
    got = m.rows.collect()
    assert len(got) == len(rows) and all(r._size == 1 for r in got)
    taken = by_source(got, m)
    assert all(abs(taken[s] - t) <= 80 for s, (_, t) in m.sources.items())
    assert sorted(map(str, got)) == sorted(map(str, mix(docs).rows.collect()))
    both = mix(docs.where("source IS NOT NULL"), F.array("source", F.lit("s1")), quotas=lambda sizes, most: {"s1": 3000, "s0": 2000, "s2": 100, "s3": 0})
    assert abs(both.rows.agg(F.sum(F.col(both.copies) * F.col(both.size))).first()[0] - 5100) < 200
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r[m.copies] for r in got)
    assert mixed_documents(docs.limit(0)).count() == 0


def test_a_part_of_tied_rows(spark):
    docs = spark.createDataFrame([(None, "five words are in here", f"s{i % 2}") for i in range(200)], "doc_id long, text string, source string")
    m = mix(docs)
    taken = by_source(m.rows.collect(), m)
    assert m.sources["s0"] == (500, pytest.approx(1000 / 3)) and all(abs(taken[s] - t) <= 5 for s, (_, t) in m.sources.items())
    one = mix(docs.withColumn("doc_id", F.lit(7).cast("long")).withColumn("source", F.lit(None).cast("string")))
    assert by_source(one.rows.collect(), one) == {None: 1000}


def test_copies_in_other_sources_come_last(spark):
    """A source takes its own texts before those that another one needs."""
    rows = [(i, f"only here {i}", "a") for i in range(100)] + [(1000 + i, f"in both sources {i}", s) for i in range(100) for s in "ab"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mix(docs, quotas=lambda sizes, most: {"a": 300, "b": 400})
    got = m.rows.collect()
    assert by_source(got, m) == {"a": 300, "b": 400}
    assert all(r[m.copies] == 1 for r in got if r.text.startswith("only")) and all(r[m.copies] == (r.source == "b") for r in got if r.text.startswith("in both"))


def test_the_contract(spark):
    """Sizes and targets by SQL; every source near its target."""
    con = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    want = con.execute(f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM '{sf}/documents.parquet'),
      s AS (SELECT source, sum(size) AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source)
      SELECT doc_id, size, n, w, sum(n) OVER () FROM d JOIN s USING (source)""".replace("\\\\", "\\")).fetchall()
    got = {r.doc_id: r for r in op10_source_mix(spark, sf).collect()}
    assert {i: (n, size) for i, n, size, _, _ in want} == {r.doc_id: (r.size, r.source_size) for r in got.values()}
    weight, source = {i: w for i, _, _, w, _ in want}, dict(con.execute(f"SELECT doc_id, source FROM '{sf}/documents.parquet'").fetchall())
    level = {r.target / weight[i] for i, r in got.items() if r.target < 3 * r.source_size - 1e-6}
    assert max(level) - min(level) < 1e-6 * max(level)
    taken, target = Counter(), {}
    for i, r in got.items():
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[source[i]] += r.taken
        target[source[i]] = r.target
    assert abs(sum(target.values()) - sum(n for _, n, *_ in want)) < 1
    assert all(abs(target[s] - taken[s]) <= max(15, 0.005 * target[s]) for s in taken)


def test_a_long_document_at_the_edge(spark):
    """What a long document can't fill, short ones do."""
    rows = [(i, "w " * (500 if i % 10 == 0 else 20 + i % 7), f"s{i % 3}") for i in range(600)] + [(1000 + i, f"shared {i % 40} " + "v " * (100 + i % 40), f"s{i // 40}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mix(docs)
    taken = by_source(m.rows.collect(), m)
    assert all(abs(t - taken[s]) <= 20 for s, (_, t) in m.sources.items())
