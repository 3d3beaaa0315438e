"""Two-column specification sheets as rows: sections and editions hold on along a sheet, labels find their keys by the longest alias.

A sheet's order matters, so lines carry their number; what holds on is filled forward in two levels (runs.py), and the
first of several lines with one key and edition counts, by aggregation. Aliases are tables, broadcast; only a sheet's
different labels meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions.numeric import locale_number
from .catalog import longest_alias
from .runs import filled_forward

#: Labels of the line that names an edition; numbering before a section's title.
VERSION_LABELS = ("phien ban", "version")
SECTION_NUMBER = r"^([0-9]+|[ivx]+)[.)]\s*"
TRIPLE = ("length_mm", "width_mm", "height_mm")


def edition(header: Column, series: str) -> Column:
    """What a version line names after the product; null for the product alone."""
    return F.nullif(Q.edition_of(header, series), F.lit(""))


def _dimension(value: Column) -> Column:
    """Length, width and height of one text, an array of (key, value); parts that aren't numbers are left out."""
    parts = F.split(value, r"\s*[x×X]\s*")
    made = F.transform(parts, lambda p, i: F.struct(F.get(F.array(*map(F.lit, TRIPLE)), i).alias("key"), locale_number(F.regexp_extract(p, r"([0-9][0-9.,]*)", 1)).alias("value")))
    return F.transform(F.filter(made, lambda x: x.key.isNotNull() & x["value"].isNotNull()), lambda x: F.struct(x.key.alias("key"), F.when(x["value"] == F.floor(x["value"]), x["value"].cast("long").cast("string")).otherwise(x["value"].cast("string")).alias("value")))


def spec_rows(lines: DataFrame, labels: DataFrame, features: DataFrame, sections: DataFrame, editions: DataFrame, series: str) -> DataFrame:
    """(sheet, edition, category, key, value, unit, row_no) of lines (sheet, row_no, label, value).

    labels: alias, ord, key, unit, category, of normalised labels; a key dimension_triple stands for length, width and height.
    features: alias, ord, key, category, of strictly normalised labels, for what labels doesn't know. sections: title, category.
    editions: sheet, said, edition, other names of editions. What neither table knows keeps its label as key, under the open section.
    """
    rows = lines.where("trim(coalesce(label, '')) <> ''").select("sheet", "row_no", F.btrim("label").alias("label"), F.coalesce(F.btrim("value"), F.lit("")).alias("value"))
    rows = rows.withColumns({"norm": Q.label_norm(F.col("label")), "strict": Q.label_norm_strict(F.col("label"))})
    is_version = F.col("norm").isin(*VERSION_LABELS)
    said = F.when(is_version, F.coalesce(edition(F.col("value"), series), F.lit("")))
    title = F.when(~is_version & (F.col("value") == ""), F.regexp_replace("norm", SECTION_NUMBER, ""))
    rows = rows.withColumns({"said": said, "title": title}).join(F.broadcast(sections.withColumnRenamed("category", "section")), "title", "left")
    for held in ("said", "section"):
        rows = filled_forward(rows, ["sheet"], "row_no", held)
    rows = rows.where(~is_version & (F.col("value") != "")).drop("title")
    names = editions.select("sheet", "said", F.col("edition").alias("named"))
    rows = rows.join(F.broadcast(names), ["sheet", "said"], "left").withColumn("edition", F.nullif(F.coalesce("named", "said"), F.lit("")))
    rows = rows.withColumn("value", F.regexp_replace("value", r"\s*\n\s*", " "))
    rows = longest_alias(rows, "norm", labels.select("alias", F.struct("key", "unit", "category").alias("target"), "ord")).withColumnRenamed("target", "known").drop("alias")
    rows = longest_alias(rows, "strict", features.select("alias", F.struct("key", "category").alias("target"), "ord")).withColumnRenamed("target", "feature").drop("alias")
    plain = F.array(F.struct(F.coalesce("known.key", "feature.key", "norm").alias("key"), F.col("value").alias("value")))
    triple = F.col("known.key") == "dimension_triple"
    each = rows.select(
        "sheet", "edition", "row_no", F.coalesce("known.category", "feature.category", "section", F.lit("general")).alias("category"),
        F.when(triple, "mm").otherwise(F.coalesce("known.unit", F.lit(""))).alias("unit"), F.inline(F.when(triple, _dimension(F.col("value"))).otherwise(plain)),
    )
    first = each.groupBy("sheet", "edition", "key").agg(F.min(F.struct("row_no", "category", "value", "unit")).alias("r"))
    return first.select("sheet", "edition", "r.category", "key", "r.value", "r.unit", "r.row_no")


def inherited(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """rows with those of parent editions for the editions that take theirs over (sheet, edition, parent); what such an edition says itself goes before."""
    taken = rows.withColumnRenamed("edition", "parent").join(F.broadcast(parents), ["sheet", "parent"]).select(*rows.columns)
    own = rows.select("sheet", "edition", "key")
    return rows.unionByName(taken.join(own, ["sheet", "edition", "key"], "left_anti"))
