"""What supports an answer: specifications that a question is about, and claims held against evidence.

Words meet by equality: a table of word groups is an inverted index from token to group, and questions and
specifications join on the groups they have in common, never pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.text import TOKEN
from ..sources.store import cut
from .retrieval import small

DIRECT, SHARED, NEITHER = 0.9, 0.7, 0.3
#: Keys of a class that are paired at once, and tasks at least that write pairs out.
BLOCK, PRODUCTS = 256, 96


def words(text: Column) -> Column:
    """Distinct lower-cased tokens, single letters too."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1)))


def word_groups(spark, groups: tuple = T.SPEC_WORDS) -> DataFrame:
    """(token, group) of a table of (group, phrases)."""
    rows = spark.createDataFrame([(g, p) for g, phrases in groups for p in phrases], "group string, phrase string")
    return rows.select("group", F.explode(words(F.col("phrase"))).alias("token")).distinct()


def _classed(rows: DataFrame, by: list[str], key: str, known: DataFrame | None = None) -> DataFrame:
    """(by, key, class) of rows (by, key, token). The class holds the key's tokens in order, of known ones if given."""
    rows = rows if known is None else rows.join(small(known), "token", "left_semi")
    return rows.groupBy(*by, key).agg(F.array_join(F.array_sort(F.collect_set("token")), " ").alias("class"))


def _blocks(classed: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, class, keys): the keys of each class in arrays of about BLOCK."""
    counts = classed.groupBy(*by, "class").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    dealt = classed.join(small(counts), [*by, "class"]).withColumn("block", F.pmod(F.xxhash64(key), F.col("n")))
    return dealt.groupBy(*by, "class", "block").agg(F.collect_list(F.struct(key)).alias(key)).drop("block")


def relevance(questions: DataFrame, specs: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """(by, question, spec, score) of questions (by, question, text) and specs (by, spec, key, value) with the same `by`.

    Both have words of one group: 0.9; a word in common: 0.7. Pairs that share neither score NEITHER and have no row. groups: (token, group).
    Keys with the same words form a class. Classes meet by what they share; their pairs are written out from blocks of keys at the end,
    and no pair of keys is shuffled.
    """
    asked = questions.select(*by, "question", F.explode(words(F.col("text"))).alias("token"))
    told = cut(_classed(specs.select(*by, "spec", F.explode(words(F.concat_ws(" ", "key", "value"))).alias("token")), by, "spec"))
    each = lambda classes: classes.select(*by, "class").distinct().select(*by, "class", F.explode(F.split("class", " ")).alias("token"))
    known = each(told).select("token").unionByName(groups.select("token")).distinct()
    asked = cut(_classed(asked, by, "question", known))
    groups = small(groups)
    of_group = lambda rows: rows.join(groups, "token").drop("token").distinct()
    ours, theirs = each(asked).withColumnRenamed("class", "ours"), each(told).withColumnRenamed("class", "theirs")
    close = of_group(ours).join(of_group(theirs), [*by, "group"]).select(*by, "ours", "theirs", F.lit(DIRECT).alias("score"))
    shared = ours.join(theirs, [*by, "token"]).select(*by, "ours", "theirs", F.lit(SHARED).alias("score"))
    met = close.unionByName(shared).groupBy(*by, "ours", "theirs").agg(F.max("score").alias("score"))
    met = met.join(_blocks(asked, by, "question").withColumnRenamed("class", "ours"), [*by, "ours"]).join(_blocks(told, by, "spec").withColumnRenamed("class", "theirs"), [*by, "theirs"])
    # A row stands for up to BLOCK * BLOCK pairs: rows are dealt out by number, not by size.
    tasks = max(PRODUCTS, int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = met.select(*by, "question", "spec", "score").repartition(tasks)
    return pairs.select(*by, F.explode("question").alias("q"), "spec", "score").select(*by, "q.question", F.explode("spec").alias("s"), "score").select(*by, "question", "s.spec", "score")


def features(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({T.FEATURES})"), F.lit(1)))


def numbers(text: Column) -> Column:
    """Distinct whole numbers, `.` and `,` between digits left out; spans like 10-70 aren't numbers."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), "[0-9]+[-–][0-9]+", ""), F.lit("([0-9][0-9.,]*[0-9]|[0-9]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "[.,]", "").cast("double")))


def claimed_numbers(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern in T.NO_CLAIM:
        out = F.regexp_replace(out, pattern, "camera" if pattern.startswith("camera") else "")
    return numbers(out)


def _tight(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\s\-_]", "")


def plain_words() -> list[tuple[list[str], list[str]]]:
    """Of each group of SPEC_WORDS the tokens of plain letters, which keys have, and the others, which answers use."""
    import re

    out = []
    for _, phrases in T.SPEC_WORDS:
        tokens = sorted({t for p in phrases for t in re.findall(TOKEN, p)})
        out.append(([t for t in tokens if t.isascii()], [t for t in tokens if not t.isascii()]))
    return out


def _context(tool: Column, key: Column, value: Column) -> tuple[Column, Column]:
    """(feature terms, text) of a piece of evidence: a specification's key counts as a term, with its other names and the words of its group."""
    low = F.lower(F.coalesce(key, F.lit("")))
    other, group = F.array().cast("array<string>"), None
    for name, names in T.KEY_ALIASES:
        other = F.when(low == name, F.array(*map(F.lit, names))).otherwise(other)
    for plain, said in plain_words():
        if plain:
            hit = F.exists(F.array(*map(F.lit, plain)), lambda w: F.contains(low, w))
            made = F.array(*map(F.lit, said)).cast("array<string>")
            group = F.when(hit, made) if group is None else group.when(hit, made)
    group = group.otherwise(F.array().cast("array<string>"))
    of_spec = F.concat(F.array(low), features(key), features(value), group, other)
    terms = F.when(tool == "get_specs", of_spec).when(tool == "get_price", F.array(F.lit("giá"), F.lit("price"))).otherwise(features(value))
    text = F.when(tool == "get_specs", F.concat_ws(" ", F.array_join(other, " "), key, value)).otherwise(F.concat_ws(" ", key, value))
    return F.filter(terms, lambda t: t != ""), F.lower(text)


def grounded(answers: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_features, unmatched, bad_numbers, grounded) of answers (by, text, question) against evidence (by, tool, key, value).

    A feature of an answer is matched by a term of its evidence that holds it or that it holds, or by the evidence's text; what a
    negative answer says of a feature asked for needs the text itself. Half of them unmatched is too much. A number must be in
    the question or the evidence (1 to 9 needn't); beside prices one of the prices, or near a large number of a specification.
    Answers with prices alone aren't held to numbers; those without evidence aren't grounded. Claims and evidence meet on `by`.
    """
    t, q = F.col("text"), F.col("question")
    claims = answers.select(*by, features(t).alias("f"), F.lower(t).rlike(T.NEGATIVE).alias("negative"), features(q).alias("qf"), F.array_except(claimed_numbers(t), numbers(q)).alias("n"), F.lower(t).rlike(T.PRICE_TALK).alias("of_price"))
    claims = claims.withColumn("n", F.filter("n", lambda x: ~((x >= 1) & (x <= 9))))
    terms, text = _context(F.col("tool"), F.col("key"), F.col("value"))
    pieces = evidence.select(*by, "tool", terms.alias("terms"), text.alias("raw"), numbers(F.col("value")).alias("nums"))
    kinds = pieces.groupBy(*by).agg(F.bool_and(F.col("tool").isin("get_price", "list_available_models")).alias("no_specs"), F.bool_or(F.col("tool") == "get_price").alias("has_price"), F.bool_or((F.size("terms") > 0) | (F.btrim("raw") != "")).alias("has_context"), F.bool_or((F.col("tool") == "get_price") & (F.size("nums") > 0)).alias("has_amount"))
    one = F.transform("f", lambda x: F.struct(x.alias("feature"), F.lit(None).cast("double").alias("number")))
    two = F.transform("n", lambda x: F.struct(F.lit(None).cast("string").alias("feature"), x.alias("number")))
    each = claims.select(*by, F.explode(F.concat(one, two)).alias("c"), "negative", "qf", "of_price")
    feature, number = F.col("c").feature, F.col("c").number
    in_text = F.contains(_tight(F.col("raw")), _tight(feature)) | F.contains("raw", feature)
    in_terms = F.exists("terms", lambda x: F.contains(_tight(x), _tight(feature)) | F.contains(_tight(feature), _tight(x)))
    strict = F.col("negative") & F.array_contains("qf", feature)
    spec, price = F.col("tool") == "get_specs", F.col("tool") == "get_price"
    near = spec & F.exists("nums", lambda s: (s > 1000) & (F.abs(number - s) / s < 0.01))
    held = F.array_contains("nums", number)
    met = each.join(pieces, by).groupBy(*by, "c", "of_price").agg(
        F.bool_or(F.when(strict, in_text).otherwise(in_terms | in_text)).alias("matched"), F.bool_or(held).alias("known"), F.bool_or((price & held) | near).alias("priced")
    )
    met = met.join(kinds.select(*by, "has_amount"), by)
    bad = F.col("c").number.isNotNull() & (~F.col("known") | (F.col("of_price") & F.col("has_amount") & ~F.col("priced")))
    counts = met.groupBy(*by).agg(F.count_if(F.col("c").feature.isNotNull() & ~F.col("matched")).alias("unmatched"), F.count_if(bad).alias("bad_numbers"))
    rows = claims.select(*by, F.size("f").alias("n_features")).join(kinds, by, "left").join(counts, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    said = (F.col("n_features") == 0) | ~F.coalesce("has_context", F.lit(False)) | (2 * zero("unmatched") < F.col("n_features"))
    counted = (F.col("no_specs") & F.col("has_price")) | (zero("bad_numbers") == 0)
    return rows.select(*by, "n_features", zero("unmatched").alias("unmatched"), zero("bad_numbers").alias("bad_numbers"), F.coalesce(F.col("has_price").isNotNull() & said & counted, F.lit(False)).alias("grounded"))
