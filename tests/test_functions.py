import uuid

import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import html
from millrace.functions import text as X
from millrace.functions.numeric import cosine, locale_number, percent
from millrace.streaming import folds


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_uuid5_as_python(spark):
    for name in ("a8:all:x:1", "é", ""):
        assert one(spark, X.uuid5(F.col("n")), n=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_marks_slugs_numbers(spark):
    assert one(spark, X.strip_marks(F.col("t")), t="Éà Đường é") == "ea duong e"
    assert one(spark, X.slug(F.col("t")), t="  Ça va, où? ") == "ca-va-ou"
    assert one(spark, X.slug(F.col("t")), t="???") == "section"
    values = ["1.234.567", "4,5", "1,234", "12 000", "x", "0.75"]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "t string").select(locale_number(F.col("t")).alias("x")).collect()]
    assert got == [1234567.0, 4.5, 1234.0, 12000.0, None, 0.75]
    assert one(spark, percent(F.lit(1), F.lit(0))) == 0.0


def test_sentences_pack_with_overlap(spark):
    text = " ".join(f"Sentence number {i} ends here." for i in range(12))
    pieces = one(spark, X.packed_sentences(F.col("t"), 100), t=text)
    assert all(len(p) <= 100 for p in pieces)
    for a, b in zip(pieces, pieces[1:]):
        assert b.startswith(a[a.rindex("Sentence") :])


def test_sentences_keep_their_digits(spark):
    text = "0 zero. 1 one is here.  2 two!\x0b3 three\n\u00a0 4 four?\t5"
    assert one(spark, X.sentences(F.col("t")), t=text) == ["0 zero.", "1 one is here.", "2 two!\x0b3 three", "4 four?", "5"]


def test_lines_and_money(spark):
    assert one(spark, X.clean_line(F.col("t")), t="see [the site](http://x) <b>now</b>") == "see the site now"
    assert one(spark, X.clean_line(F.col("t")), t="PAGE 3 of 9") == ""
    assert one(spark, X.without_money_paragraphs(F.col("t")), t="keep this\n\nThe price is 1.200.000 VND\n\nalso $5") == "keep this\n\nalso $5"
    assert one(spark, X.text_type(F.col("t")), t="- a\n- b") == "list"


def test_cosine_of_nothing(spark):
    assert one(spark, cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_html_walk():
    title, blocks = html.walk("<title>T | site</title><nav>no</nav><h1>A</h1><p>one <b>two</b></p><h2>B</h2><ul><li>x<li>y</ul><h1>C</h1><table><tr><td>1<td>2</tr></table><script>bad('</p>')</script>")
    assert title == "T"
    assert blocks == [("A", "one two"), ("A > B", "- x\n- y"), ("C", "| 1 | 2 |\n| --- | --- |")]
    _, blocks = html.walk(
        "<h1>L</h1><ol><li>one<li>two <b>b</b><ul><li>in<li>ner</ul></li><li>three</ol><p>see <img src=x alt='a picture'>!</p><pre>a  b\n c</pre><blockquote>said</blockquote><hr>"
        "<table><tr><th>k</th><th>a|b</th></tr><tr><td><p>1</p></td><td></td></tr></table><dl><dt>term</dt><dd>what it is</dd></dl>loose<br>text<table><tr><td>open"
    )
    assert [b for _, b in blocks] == [
        "1. one\n2. two b\n  - in\n  - ner\n3. three", "see a picture !", "```\na  b\n c\n```", "> said", "---",
        "| k | a\\|b |\n| --- | --- |\n| 1 |   |", "- **term**: what it is", "loose text", "| open |\n| --- |",
    ]
    assert {c for c, _ in blocks} == {"L"}
    assert html.walk(None) == ("", [])
    assert html.packed([("a", "x" * 3200), ("a", "y")])[-1] == ("a", "x" * 200 + "\ny")


def frame(**columns):
    return pd.DataFrame(columns)


def test_token_bucket_runs_empty_and_refills():
    rows = frame(client_ip=["a"] * 9, event_id=range(9), at_ms=[0] * 7 + [2000, 60_000])
    state, out = folds.token_bucket(None, rows)
    assert out["allowed"].tolist() == [True] * 5 + [False, False, True, True]
    assert out["retry_after_s"].tolist()[5] == 2.0
    first, a = folds.token_bucket(None, rows[:4])
    _, b = folds.token_bucket(first, rows[4:])
    assert pd.concat([a, b])["allowed"].tolist() == out["allowed"].tolist()


def test_cooldown_counts_from_the_last_sent_one():
    rows = frame(alert_type=["x"] * 5, event_id=range(5), at_ms=[0, 400_000, 600_000, 900_000, 1_200_000])
    assert folds.cooldown(None, rows)[1]["notify"].tolist() == [True, False, True, False, True]


def test_noise_knows_words_of_ascii(spark):
    lines = ["Éçê.", "Èê", "copyrighté", "copyrights", "menu\r", "Page 3\r", "\u00a0login\u2003", "see <!-- a\rb -->it", "\u00a0a\u00a0"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, t string").select("i", X.clean_line(F.col("t")).alias("x")).orderBy("i")
    assert [r.x for r in rows.collect()] == ["", "Èê", "", "copyrights", "", "Page 3\r", "", "see it", "a"]
