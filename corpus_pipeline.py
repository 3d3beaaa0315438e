"""The corpus pipeline: language ID, line dedup, near duplicates, source mix, packing.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a
DataFrame; all but the last return the columns of `documents`. `run` applies them in turn, each
result written to the shared folder before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.language_id import identify, samples
from millrace.llm.line_dedup import remove_boilerplate
from millrace.llm.near_duplicates import near_duplicates
from millrace.llm.packing import packed, pieces
from millrace.llm.source_mix import mixed_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be recognised; null texts and texts without a letter go."""
    held = common.held_out(F.col("doc_id"), 4, 2)
    lang, score = common.unused(docs, "lang_pred", "score")
    return identify(docs, samples(docs.where(~held)), keep_text=True, names=(lang, score)).where(F.col(lang) != "und").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; those that had words and lost all of them go."""
    word = F.coalesce(F.col("text").rlike(common.WORD_RE), F.lit(False))
    rows, _, removed = remove_boilerplate(docs)
    changed = F.col(removed) > 0
    return rows.where(~changed | word).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; documents without words stay."""
    (row,) = common.unused(docs, "row")
    rows = docs.withColumn(row, F.col("doc_id").cast("long"))
    if not rows.groupBy(row).count().where(F.col("count") > 1).isEmpty() or not rows.where(F.col(row).isNull()).isEmpty():
        rows = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    gone = common.cut(near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).where("doc_id <> component_id").select(F.col("doc_id").alias(row)))
    few = common.has_rows_within(gone, 1_000_000)
    return rows.join(F.broadcast(gone) if few else gone, row, "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences."""
    return packed(common.cut(pieces(docs, public_tokenizers.path("word_bpe_49k.json"))))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicate_removal),
    ("source_mix", source_mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenization can't be expressed in SQL: tests hold the stages against brute force instead.
ORACLE_SQL = None
