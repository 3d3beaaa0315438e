"""Readers: delimited, JSON, JSON lines, link lists, crawl files, JDBC. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
CHUNK = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("id", T.StringType()), ("collection", T.StringType()), ("vector_version", T.StringType()), ("model_id", T.StringType()), ("edition_id", T.StringType()), ("category", T.StringType()),
        ("section_path", STRINGS), ("text", T.StringType()), ("text_type", T.StringType()), ("structured", T.MapType(T.StringType(), T.StringType())), ("language", T.StringType()), ("tags", STRINGS),
        ("confidence", T.DoubleType()), ("source_file", T.StringType()), ("source_url", T.StringType()), ("source_type", T.StringType()), ("fetched_at", T.StringType()), ("ingested_at", T.StringType()),
        ("page", T.StringType()), ("is_hot", T.BooleanType()), ("_corrupt", T.StringType()),
    )]
)
TEXT_TYPES = ("prose", "table", "list", "qa_pair", "heading", "spec", "faq")


def pipe_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All strings; empty fields are null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", True).option("sep", "|").option("multiLine", True).csv(path)
    return rows.select([F.nullif(F.col(c), F.lit("")).alias(c) for c in columns])


def chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected ones with a reason) of JSON lines."""
    rows = spark.read.schema(CHUNK).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    reason = (
        F.when(F.col("_corrupt").isNotNull(), "not JSON")
        .when(F.coalesce(F.btrim("text"), F.lit("")) == "", "no text")
        .when(F.coalesce(F.size("section_path"), F.lit(0)) < 1, "no section")
        .when(F.coalesce(F.size("tags"), F.lit(0)) < 1, "no tags")
        .when(~F.coalesce(F.col("text_type").isin(*TEXT_TYPES), F.lit(False)), "text type")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence")
    )
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason", "_corrupt"), marked.where("reason IS NOT NULL")


def json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def links(spark: SparkSession, path: str) -> DataFrame:
    """(label, url) of lines `label: url`; comments and blank lines go."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    cut = F.split("value", r":\s*", 2)
    return rows.select(F.btrim(F.get(cut, F.lit(0))).alias("label"), F.btrim(F.get(cut, F.lit(1))).alias("url")).where("url IS NOT NULL")


def crawl_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta map, body) of crawl files: `# key: value` lines, a line of equals signs, the body."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    cut = F.split("value", r"(?m)^={5,}\s*$", 2)
    head = F.when(F.size(cut) > 1, F.get(cut, F.lit(0))).otherwise(F.lit(""))
    plain = F.btrim(F.regexp_replace(head, r"(?m)^#\s*", ""), F.lit("\n "))
    meta = F.transform_values(F.transform_keys(F.str_to_map(plain, F.lit("\n"), F.lit(":")), lambda k, v: F.lower(F.btrim(k))), lambda k, v: F.btrim(v))
    return rows.select("path", meta.alias("meta"), F.btrim(F.element_at(cut, -1), F.lit("\n ")).alias("body"))


def spec_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, label, value) of two-column sheets, in order; a row without a value opens a section."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("t"))
    lines = rows.select("path", F.posexplode(F.split("t", r"\r?\n(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")).alias("row_no", "line")).where("trim(line) <> ''")
    cells = F.from_csv("line", "label string, value string, rest string")
    return lines.select("path", "row_no", cells.alias("c")).select("path", "row_no", F.btrim("c.label").alias("label"), F.nullif(F.btrim("c.value"), F.lit("")).alias("value"))


def jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table read in ranges of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.options(**options).load()


def eval_cases(spark: SparkSession, path: str, lists: tuple[str, ...] = ("expected_facts", "must_not_do"), columns: tuple[str, ...] = ("test_id", "conversation_id", "turn_index", "user_query", "expected_decision")) -> DataFrame:
    """Evaluation cases of a delimited file with header and quoted fields; `lists` hold JSON arrays of strings. Cases without id or question go."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, *lists)])
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.select(*[F.btrim(c).alias(c) for c in columns], *[F.coalesce(F.from_json(c, STRINGS), F.array().cast(STRINGS)).alias(c) for c in lists])
    return rows.where("coalesce(test_id, '') <> '' AND coalesce(user_query, '') <> ''")


def row_count(spark: SparkSession, path: str) -> int:
    """Records of a delimited file with header; line breaks inside quotes don't count."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).count()
