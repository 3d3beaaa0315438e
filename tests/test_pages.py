import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import html, js
from millrace.functions.repair import Replacer, longest_first, repairer
from millrace.operators import configurator as C
from millrace.plans import pages as plans

WORD = st.text("ab@", min_size=0, max_size=4)


@settings(max_examples=500, deadline=None)
@given(st.text("ab@ ", max_size=60), st.lists(st.tuples(WORD, WORD), max_size=12))
def test_as_replacing_entry_after_entry(text, entries):
    """Longest first; what a replacement puts together is found by the entries after it."""
    want = text
    for bad, good in longest_first(entries):
        want = want.replace(bad, good) if bad else want
    assert Replacer(longest_first(entries)).apply(text) == want
    kept = {}
    for bad, good in entries:
        kept.setdefault(bad, good)
    assert longest_first(entries) == sorted(kept.items(), key=lambda e: -len(e[0]))


def test_a_large_dictionary_and_a_long_text():
    words = [f"w{i}q" for i in range(20_000)]
    text = " ".join(words[i * 7 % 20_000] for i in range(30_000))
    assert Replacer(longest_first((w, w.upper()) for w in words)).apply(text) == text.upper()


def test_contexts_of_unreadable_characters(spark):
    repair = repairer(spark, [("lamp", "Lamp"), ("amp;", "never")], [("xo@@n", "xoắn"), ("@@n", "un")])
    rows = spark.createDataFrame([("xo�n ti�n �", 1), ("Ж lаmp &amp; �", 2), (None, 3), ("", 4), ("a@@n", 5)], "t string, k int")
    assert [r.x for r in rows.select(repair(F.col("t")).alias("x"), "k").orderBy("k").collect()] == ["xoắn tiun ", "Ж Lamp & ", None, "", "aun"]


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=15))
def test_json_reads_as_itself(value):
    text = json.dumps({"v": value}, ensure_ascii=False)
    assert json.loads(js.assigned(f"x = 1; my.obj = {text}; more()", "my.obj")) == {"v": value}


def test_literals_that_are_not_json():
    text = """cfg = {a: 'it\\'s "x" ];', 'b-c': [1, .5, -2, 0x1F, !0, undefined,], // c }\n d: `e}`, /* ] */ "f": {}, g: NaN}; cfg = {late: 1}"""
    assert json.loads(js.assigned(text, "cfg")) == {"a": "it's \"x\" ];", "b-c": [1, ".5", -2, "0x1F", True, None], "d": "e}", "f": {}, "g": None}
    for bad in (None, "", "cfg = 3", "cfg == {a: 1}", "mycfg = {}", "cfg = {a: [1, 2}", "cfg = {a: f(1)}"):
        assert js.assigned(bad, "cfg") in (None, '{"a":[1,2}')


def test_pages_without_a_readable_object(spark):
    rows = spark.createDataFrame([(1, None), (2, "<p>x</p>"), (3, "shop = {products: 5}"), (4, "shop = {products: {models: [{id: 'a'}, 7, null], a: {model: 1, b: 3, c: {price: 2, listColor: 'no'}}}}")], "page_id long, html string")
    read = C.read(rows, "shop")
    assert [(r.page_id, r.variant_code, r.price, r.colours) for r in C.variants(read, "page_id").collect()] == [(4, "c", 0, [])]
    assert C.options(read, "page_id").collect() == []


def test_breadcrumbs_by_windows_as_by_the_walk(spark):
    pages = [
        (1, "<title>T | s</title><p>start</p><h2>B</h2><p>b</p><h3>C</h3><ul><li>x<li>y</ul><h2>D</h2><h6>deep</h6><table><tr><td>1</table><h1>A</h1><p>a</p>"),
        (2, ""), (3, None), (4, "<p>no title</p><h3>x</h3><h3>y</h3><p>z</p>"),
    ]
    got = html.page_blocks(spark.createDataFrame(pages, "page_id long, html string")).orderBy("page_id", "seq").collect()
    for page, text in pages:
        _, blocks = html.walk(text)
        assert [(r.breadcrumb, r.text) for r in got if r.page_id == page and r.level == 0] == blocks
    assert [(r.level, r.breadcrumb) for r in got if r.page_id == 1 and r.level] == [(2, "B"), (3, "B > C"), (2, "D"), (6, "D > deep"), (1, "A")]


def test_ampersands_without_a_reference_are_text(spark, tmp_path):
    """As the query's SQL has it: five references, each with its semicolon."""
    spark.createDataFrame([(1, "<title>a&amp</title><h1>b&amp</h1><p>c &copy; &#39;d&lt;&</p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [r.text for r in plans.web_page_blocks(spark, str(tmp_path)).orderBy("seq").limit(2).collect()]
    assert got == [hashlib.md5(x.encode()).hexdigest() for x in ("b&amp", "c &copy; 'd<&")]


def test_only_the_part_from_the_name_on_is_read(spark):
    pages = ["<p>long</p>" * 50 + " my.obj = {a: 1};", "my.obj = {b: 2}", "xmy.obj = {c: 3}; my.obj={d: 4}", "none", "", None, "é my.obj = [5]"]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string").coalesce(1)
    made = rows.select("i", js.from_name(F.col("html"), "my.obj").alias("part"), js.assigned_json(F.col("html"), "my.obj").alias("v")).orderBy("i").collect()
    assert [r.v for r in made] == [js.assigned(p, "my.obj") for p in pages] and made[2].v == '{"d":4}'
    assert made[0].part == " my.obj = {a: 1};" and made[3].part is None
