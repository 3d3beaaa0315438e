import datetime
import random

from pyspark.sql import functions as F

from millrace.operators import answers as A


def test_chunks_citations_and_pages(spark):
    chunks = spark.createDataFrame(
        [(1, "a", 0.9, 1, "u1", "10"), (1, "b", 0.9, 2, "u1", "2"), (1, "c", 0.2, 3, "u2", ""), (1, "d", 0.5, 4, "u2", None), (1, "e", 0.3, 5, "", "7"), (2, "f", 0.4, 1, "u9", "iv"), (2, "g", 0.4, 2, "u9", "1"), (2, "g", 0.3, 3, "u9", "1")],
        "q int, chunk_id string, score double, pos int, url string, page string",
    )
    ranked = A.ranked_chunks(chunks, ["q"], ["pos"], most=3)
    assert sorted((r.q, r.rank, r.chunk_id) for r in ranked.collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "d"), (2, 1, "f"), (2, 2, "g"), (2, 3, "g")]
    citations = spark.createDataFrame([(1, 5, "u2", "MK 6", "specs"), (1, 2, "u1", "", "manual"), (1, 7, "u1", "late", "x"), (1, 9, "u3", None, None), (1, 10, "", "a", "b"), (2, 1, "u9", "MK 8", "kb")], "q int, pos int, url string, model string, label string")
    got = [(r.q, r.citation_id, r.text, r.chunk_ids, r.pages) for r in A.displayed(citations, ranked, ["q"]).orderBy("q", "citation_id").collect()]
    assert got == [(1, "cit_001", "manual (trang 2, 10)", ["a", "b"], "2, 10"), (1, "cit_002", "MK 6 — specs", ["d"], ""), (1, "cit_003", "u3", [], ""), (2, "cit_001", "MK 8 — kb (trang iv, 1)", ["f", "g"], "iv, 1")]


def test_links_by_kind_then_place(spark):
    rows = spark.createDataFrame([(1, 1, "other", "u4", "n4"), (1, 2, "search_knowledge_base", "u1", "n1"), (1, 3, "get_specs", "u2", "n2"), (1, 4, "get_price", "u2", "n3"), (1, 5, "get_specs", "", "no"), (1, 6, "get_specs", "u5", None)], "q int, pos int, tool string, url string, name string")
    assert [r.links for r in A.source_links(rows, ["q"]).collect()] == ["[n2](u2), [](u5), [n1](u1), [n4](u4)"]


def test_sessions_touched(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    old = spark.createDataFrame([("a", 3, "m", at(1), "s"), ("b", 1, "k", at(2), None)], "session_id string, turn_count long, last_message string, updated_at timestamp, summary string")
    turns = spark.createDataFrame([("a", at(5), "new"), ("a", at(4), "mid"), ("c", at(3), None)], "session_id string, at timestamp, message string")
    assert sorted(tuple(r) for r in A.touched(old, turns).collect()) == [("a", 5, "new", at(5), "s"), ("b", 1, "k", at(2), None), ("c", 1, None, at(3), None)]


def test_request_rows_and_calls(spark):
    uid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    rows = spark.createDataFrame([(uid, "q" * 900, "", "", ["é"]), ("x", None, "m", "v2", None)], "session_id string, query_text string, model_used string, prompt_version string, tools_used array<string>")
    assert [tuple(r) for r in A.request_rows(rows, "base").collect()] == [(uid, "q" * 500, "base", "v1.0.0", '["é"]'), (None, "", "m", "v2", "[]")]
    t = datetime.datetime(2024, 1, 2, 3, 4, 5)
    later = lambda ms: t + datetime.timedelta(milliseconds=ms)
    calls = spark.createDataFrame([("a", "m", t, later(12.34), later(5), '{"usage": {"prompt_tokens": 7, "completion_tokens": 3}}'), ("b", "m", t, later(1), None, '{"usage": {"input_tokens": 1, "output_tokens": 2, "prompt_tokens": 9}}'), ("c", "m", t, later(1), None, "broken")], "op string, model string, begun timestamp, ended timestamp, first timestamp, response string")
    assert [tuple(r) for r in A.api_metrics(calls).orderBy("op").collect()] == [("a", "m", 12.3, 5.0, 7, 3, "2024-01-02T03:04:05Z"), ("b", "m", 1.0, None, 1, 2, "2024-01-02T03:04:05Z"), ("c", "m", 1.0, None, None, None, "2024-01-02T03:04:05Z")]


def test_raw_files_by_ordered_rules(spark):
    cases = [("https://shop.x/dat-coc-1", "pdf", "a", None, "dat-coc"), ("https://shop.x/dich-vu-bao-duong", "html", "a", None, "service"), ("https://SHOP.x/thong-tin-cuu-ho", "html", "a", None, "policy"), ("https://shop.x/", "html", "a", None, "other"), ("https://y/B", "pdf", "brochure-1", "MK 6", "brochure"), ("https://y/B", "pdf", "brochure-1", None, "pdf-manual"), ("", "html", "So-Sanh", None, "comparison"), (None, "html", "thong-so-x", None, "specs-article"), (None, None, "x", None, "article")]
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, url string, kind string, name string, model string")
    got = rows.select("i", A.raw_route(F.col("url"), F.col("kind"), F.col("name"), F.col("model"), ("shop.x",)).alias("r")).orderBy("i").collect()
    assert [r.r.kind for r in got] == [c[4] for c in cases]


def test_first_matches_without_meeting_every_row(spark):
    """The best of all pairs, from lists of `most` rows of each word or kind."""
    rng = random.Random(3)
    draw = lambda n: sorted(rng.sample("abcdefgh", n))
    told = [(i % 2, i, draw(rng.randint(0, 4))) for i in range(60)]
    asked = [(q, q % 2, draw(rng.randint(0, 5))) for q in range(30)]
    rows = spark.createDataFrame(told, "g int, pos long, t array<string>").repartition(3)
    tokens = spark.createDataFrame([(q, g, w) for q, g, ws in asked for w in ws], "q long, g int, token string")
    shared = {q: [(len(set(ws) & set(t)), pos) for h, pos, t in told if h == g and set(ws) & set(t)] for q, g, ws in asked}
    got = {r.q: r.x for r in A.first_matches(tokens, rows, "g", "pos", "x", most=3).collect()}
    assert got == {q: sorted(p for _, p in s)[:3] for q, s in shared.items() if s}
    got = {r.q: [tuple(x) for x in r.x] for r in A.most_shared(tokens, rows, "g", "pos", "x", lambda n: F.least(F.lit(0.2), n * 0.1), most=3).collect()}
    assert got == {q: sorted((-min(0.2, n * 0.1), p) for n, p in s)[:3] for q, s in shared.items() if s}
