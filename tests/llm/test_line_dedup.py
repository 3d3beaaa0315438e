import time

import duckdb
from pyspark.sql import functions as F

from millrace.llm.line_dedup import ORACLE, op2_line_dedup, remove_boilerplate


def test_by_hand(spark):
    docs = [(i, f"own line {i}\n Common footer \n\nnear", f"s{i % 12}", 1) for i in range(24)]
    docs += [(100 + i, "near\nnear enough", f"s{i % 3}", 1) for i in range(9)]
    docs += [(200 + i, "nine sites", f"s{i % 9}", 1) for i in range(30)]
    docs += [(300, None, "s1", 1), (301, "", None, 1), (None, "Common footer", "s2", 1), (5, "own line 5\n Common footer \n\nnear", "s5", 1), (302, "Common footer", None, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, _n_lines int")
    rows, n_lines, n_removed = remove_boilerplate(frame)
    assert rows.columns == ["doc_id", "text", "source", "_n_lines", "__n_lines", "_n_removed"] and {r._n_lines for r in rows.collect()} == {1}
    got = {r.doc_id: (r.text, r[n_lines], r[n_removed]) for r in rows.collect()}
    assert got[0] == ("own line 0\n Common footer \n\nnear", 3, 0)
    assert got[5] == ("own line 5\n", 3, 2) and rows.count() == len(docs)
    assert got[100] == ("near enough", 2, 1) and got[207] == ("nine sites", 1, 0)
    assert got[300] == (None, 0, 0) and got[301] == ("", 0, 0) and got[None] == ("Common footer", 1, 0) and got[302] == ("", 1, 1)


def test_exact_counts_decide_near_the_threshold(spark):
    docs = [(i, f"ten sites\n{i}", f"s{i % 10}") for i in range(40)] + [(100 + i, f"nine sites\n{i}", f"s{i % 9}") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    gone = {r.doc_id for r in remove_boilerplate(frame)[0].where("_n_removed > 0").collect()}
    assert gone == set(range(1, 40))
    assert remove_boilerplate(frame.limit(0))[0].agg(F.count("*")).first()[0] == 0


def test_clashing_names_and_long_texts(spark):
    names = ["_n_removed", "_doc", "_gone", "_clean", "_left", "_all", "h1", "pos", "site", "first"]
    docs = [(i, f"shared\n{'word ' * 60_000}{i}", f"s{i}", *[7] * len(names)) for i in range(12)]
    frame = spark.createDataFrame(docs, ["doc_id", "text", "source", *names])
    rows, _, n_removed = remove_boilerplate(frame)
    got = rows.collect()
    assert all(r[c] == 7 for r in got for c in names) and sorted(r[n_removed] for r in got) == [0] + [1] * 11
    assert all(len(r.text) > 300_000 for r in got)


def test_null_ids_in_the_operator_and_in_its_sql(spark, tmp_path):
    docs = [(None if i % 5 == 0 else i, f"own {i}\nshared", f"s{i}") for i in range(12)] + [(None, "only without ids", f"s{i}") for i in range(11)] + [(3, None, "s3"), (3, "other\nshared", None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    asked = con.execute(ORACLE)
    names = [d[0] for d in asked.description]
    got = [tuple(r[c] for c in names) for r in op2_line_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(asked.fetchall(), key=repr)


def test_many_removed_lines_of_a_text_take_linear_time(spark):
    def seconds(n):
        frame = spark.createDataFrame([(i, "\n".join(f"line {k}" for k in range(n)), f"s{i}") for i in range(11)], "doc_id long, text string, source string").repartition(4).cache()
        frame.count()
        began = time.time()
        assert sorted(r._n_removed for r in remove_boilerplate(frame)[0].collect()) == [0] + [n] * 10
        return time.time() - began

    seconds(500)
    assert seconds(16_000) < 4 * max(2, seconds(4_000))
