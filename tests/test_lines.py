"""Lines and their noise: queries on odd lines against their SQL."""

import ast
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

import millrace
from millrace import registry
from millrace.functions import text as X

#: Words with letters that Unicode folds to ASCII's or that upper or lower case alone does; ends and spaces of several kinds.
ODD = [
    *("\u017f\u017f\u017f", "\u212a\u212a\u212a", "Éçê.", "all right\u017f reserved", "licen\u017fed under x", "se\u0131te 1", "PAGE 1 OF 2", "page \u0661", "page 1\r", "log\u0130n", "log\u0131n", "login", "Share é", "\u017fhare", "sharé"),
    *("menu" + "é" * 20, "menu " + "x" * 20, "\u00a0menu\u2003", "\tmenu", "menu\t", "copyright_", "copyrighté", "---", "-\r-", "see <!-- a\rb -->it", "a<b>&nbsp;&amp;nbsp;c", "![a](b)[c]()", "[a]( b", "<>", "<\n>"),
    *("a  b", "a\tb", "a\ue000b", "a&amp;b", "x\n\n \n---\ny", "", " ", "\n", None),
]


def check(spark, tmp_path, key):
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.QUERIES[key](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[key]})").fetchall())
    return df


def test_no_module_has_two_functions_of_one_name():
    for path in Path(millrace.__file__).parent.rglob("*.py"):
        names = Counter(x.name for x in ast.parse(path.read_text()).body if isinstance(x, (ast.FunctionDef, ast.ClassDef)))
        assert [(path.name, name) for name, n in names.items() if n > 1] == []


def test_clean_lines_of_odd_texts(spark, tmp_path):
    plan = check(spark, tmp_path, "txt_clean_lines")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("&nbsp;") == 1  # every line is cleaned once


def test_bare_lines(spark):
    lines = ["plain", " a b ", "a  b", "a\tb", "![x](y)", "[x](y)", "<b>k", "<b>", "a&amp;b", "a&nbsp;b", "a\ue000b", "\uf8ff", "a \ue123 b", "a\r", "\u00a0a\u00a0\u00a0b", "", None]
    out = F.col("t")
    for pattern, to in X.CLEANED:
        out = F.regexp_replace(out, "(?d)" + pattern, to)
    rows = spark.createDataFrame([(x,) for x in lines], "t string").select(X.bare_line(F.col("t")).alias("bare"), X.trimmed(out).alias("want"))
    assert [r.bare for r in rows.collect()] == [r.want for r in rows.collect()]


def test_noise_lines_of_odd_texts(spark, tmp_path):
    check(spark, tmp_path, "txt_noise_lines")
