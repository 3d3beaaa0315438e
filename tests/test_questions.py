import time

from pyspark.sql import functions as F

from millrace.functions import questions as Q


def pieces(spark, texts, most):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", Q.table_pieces(F.col("t"), most).alias("x"))
    return [r.x for r in rows.orderBy("i").collect()]


def test_table_pieces_by_hand(spark):
    texts = ["h\n-\naa\nbb\ncc", "h\n-\naaaaaaaaa\nb\n", "h\n-", "", None]
    assert pieces(spark, texts, 6) == [["h\n-\naa\nbb", "h\n-\ncc"], ["h\n-\naaaaaaaaa", "h\n-\nb"], ["h\n-"], [""], [None]]


def test_a_long_table_takes_time_by_its_length(spark):
    table = lambda n: "h\n-\n" + "\n".join(f"{i:08d}" for i in range(n))
    pieces(spark, [table(10)], 45)
    began = time.time()
    (got,) = pieces(spark, [table(40_000)], 45)
    assert len(got) == 8000 and time.time() - began < 20
