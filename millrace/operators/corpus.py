"""Corpus cleaning: lines, sections, fragments, chunks, validation, version differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def repeated_lines_once(text: Column, least: int = 3) -> Column:
    """The lines of a text; of those that it repeats `least` times or more, only the first stays. All of it happens in the row."""
    norm = F.transform(lines(text), lambda x, i: F.struct(F.lower(F.btrim(x)).alias("norm"), i.alias("pos"), x.alias("line")))
    ordered = F.array_sort(norm)
    # Equal lines are neighbours then: a line goes if one like it comes before and the run is long enough.
    at = lambda s, k: F.get(s, k)["norm"]

    def stays(s: Column, x: Column, i: Column) -> Column:
        first = (i == 0) | (at(s, i - 1) != x["norm"])
        long = F.lit(False)
        for j in range(least):  # any window of `least` neighbours that holds this line
            window = (i - j >= 0) & F.coalesce((at(s, i - j) == x["norm"]) & (at(s, i - j + least - 1) == x["norm"]), F.lit(False))
            long = long | window
        return (x["norm"] == "") | first | ~long

    kept = F.flatten(F.transform(F.array(ordered), lambda s: F.filter(s, lambda x, i: stays(s, x, i))))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["pos"], x["line"]))), lambda x: x["line"])


def sections(text: Column, is_heading) -> Column:
    """An array of (section, title, n_lines): 0 for the lines before any heading, then one for each line that is_heading takes."""
    all_ = F.transform(lines(text), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    heads = F.filter(all_, lambda x: is_heading(x["line"]))
    row = lambda section, title, n: F.struct(section.cast("long").alias("section"), title.alias("title"), n.cast("long").alias("n_lines"))

    def made(all_: Column, h: Column) -> Column:
        n = F.size(all_)
        begin = F.coalesce(F.get(h, F.lit(0))["pos"], n)
        before = F.filter(F.array(row(F.lit(0), F.lit(None).cast("string"), begin)), lambda x: x["n_lines"] > 0)
        return F.concat(before, F.transform(h, lambda x, i: row(i + 1, F.btrim(x["line"]), F.coalesce(F.get(h, i + 1)["pos"], n) - x["pos"])))

    both = F.array(F.struct(all_.alias("all"), heads.alias("heads")))
    return F.flatten(F.transform(both, lambda b: made(b["all"], b["heads"])))


def merged_fragments(text: Column, below: int = 25) -> Column:
    """An array of (pos, members, paragraph): runs of short lines without sentence marks are one paragraph, other lines one each."""

    def short(x: Column) -> Column:
        return (F.length(F.btrim(x)) < below) & ~x.rlike("[.:;|-]") & (F.btrim(x) != "")

    def made(all_: Column) -> Column:
        flags = F.transform(all_, lambda x: F.struct(x.alias("line"), short(x).alias("short")))

        def cut(flags: Column) -> Column:
            starts = F.filter(F.transform(flags, lambda x, i: F.when(~(x["short"] & (i > 0) & F.coalesce(F.get(flags, i - 1)["short"], F.lit(False))), i)), lambda i: i.isNotNull())

            def paragraphs(starts: Column) -> Column:
                def one(i: Column, k: Column) -> Column:
                    n = F.coalesce(F.get(starts, k + 1), F.size(flags)) - i
                    parts = F.transform(F.slice(flags, i + 1, n), lambda x: F.btrim(x["line"]))
                    return F.struct(i.alias("pos"), n.alias("members"), F.array_join(parts, " ").alias("paragraph"))

                return F.transform(starts, one)

            return F.flatten(F.transform(F.array(starts), paragraphs))

        return F.flatten(F.transform(F.array(flags), cut))

    return F.flatten(F.transform(F.array(lines(text)), made))


def valid_chunk(text: Column, language: Column, tags: Column, confidence: Column, kinds: tuple[str, ...], kind: Column) -> Column:
    return F.coalesce((F.btrim(text) != "") & language.isNotNull() & (F.size(tags) > 0) & confidence.between(0, 1) & kind.isin(*kinds), F.lit(False))


def version_diff(old: DataFrame, new: DataFrame, key: str, group: str) -> DataFrame:
    """Per group how many keys came, went and changed their hash."""
    a, b = old.select(key, F.col(group).alias("g0"), F.col("hash").alias("h0")), new.select(key, F.col(group).alias("g1"), F.col("hash").alias("h1"))
    both = a.join(b, key, "full_outer")
    return both.groupBy(F.coalesce("g1", "g0").alias(group)).agg(
        F.count_if(F.col("h0").isNull()).alias("added"), F.count_if(F.col("h1").isNull()).alias("removed"), F.count_if(F.col("h0") != F.col("h1")).alias("modified")
    )


def first_by_text(rows: DataFrame, order: list) -> DataFrame:
    """One row per normalised text; blank ones go."""
    norm = F.lower(F.regexp_replace(F.btrim("text"), r"\s+", " "))
    marked = rows.withColumn("norm", norm).where("norm <> ''")
    return marked.withColumn("nth", F.row_number().over(Window.partitionBy(F.md5("norm")).orderBy(*order))).where("nth = 1").drop("nth", "norm")


def is_junk(title: Column, text: Column, titles: tuple[str, ...] = ("menu", "navigation", "footer", "contact")) -> Column:
    """Sections by title, boilerplate by pattern, and texts of which half the lines or more are short navigation."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.btrim(x) != "")
    nav = F.filter(rows, lambda x: (F.length(F.btrim(x)) < 20) & ~x.rlike("[.!?:]"))
    return F.lower(title).isin(*titles) | text.rlike(X.U + r"^\s*(cookie|privacy policy|terms of use)") | ((F.size(nav) >= 2) & (2 * F.size(nav) >= F.size(rows)))


def routed(url: Column) -> Column:
    """Collection, confidence and kind of a page by ordered rules on its URL."""
    host, path = F.lower(F.parse_url(url, F.lit("HOST"))), F.lower(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")))

    def kind(collection: str, confidence: float, name: str) -> Column:
        return F.struct(F.lit(collection).alias("collection"), F.lit(confidence).alias("confidence"), F.lit(name).alias("kind"))

    return F.when(host.isNull(), kind("general", 0.3, "unknown")).when(path.endswith(".pdf"), kind("manual", 0.9, "pdf")).when(path.rlike("/(blog|news|post)"), kind("policy", 0.7, "article")).when(
        host.rlike(r"\.org$"), kind("policy", 0.8, "page")
    ).otherwise(kind("general", 0.6, "page"))
