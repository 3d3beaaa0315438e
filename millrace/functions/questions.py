"""Column functions on questions, sources and brochure lines, over tables of words."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T
from . import text as X
from .numeric import locale_number
from .products import models_named


def relevant_categories(question: Column, table: tuple = T.TOPIC_CATEGORIES) -> Column:
    """The categories of the words that a question has; null means all of them."""
    rows = F.array(*[F.struct(F.lit(word).alias("word"), F.array(*map(F.lit, cats)).cast("array<string>").alias("cats")) for word, cats in table])
    hits = F.filter(rows, lambda x: F.contains(F.lower(question), x["word"]))
    all_ = F.exists(hits, lambda x: F.size(x["cats"]) == 0) | (F.size(hits) == 0)
    return F.when(~all_, F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda x: x["cats"])))))


def valid_citation(url: Column, text: Column, score: Column, question_tokens: Column, common: tuple[str, ...] = T.COMMON_WORDS, floor: float = 0.3) -> Column:
    """Whether a source may be cited: it has an address, and a score or words of the question that matter (if there are any words to compare)."""
    words = F.array_except(X.tokens(text, ()), F.array(*map(F.lit, common)))
    compared = (F.size(question_tokens) > 0) & (F.coalesce(text, F.lit("")) != "")
    return (F.coalesce(url, F.lit("")) != "") & (~compared | (F.coalesce(score, F.lit(0.0)) >= floor) | F.arrays_overlap(words, question_tokens))


def sorted_pages(pages: Column) -> Column:
    """Distinct page labels by number; labels that aren't numbers come first."""
    keyed = F.transform(F.array_distinct(pages), lambda p: F.struct(F.coalesce(F.when(p.rlike("^[0-9]+$"), p.try_cast("int")), F.lit(0)).alias("n"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def label_norm(label: Column) -> Column:
    """Lower case without accents, single spaces, no punctuation at the ends."""
    return F.btrim(F.btrim(F.regexp_replace(X.strip_marks(label), r"\s+", " ")), F.lit(":|-–— \t"))


def label_norm_strict(label: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(label_norm(label), r"[,:;()/&\-–—]+", " "), r"\s+", " "))


def plain_dimensions(text: Column) -> Column:
    """Lengths with thousands marks, two or three joined by x, as plain numbers: 4.241 x 1.834 becomes 4241 × 1834."""
    number = r"\d{1,3}(?:[.,]\d{3}){1,2}"
    found = F.regexp_extract_all(text, F.lit(rf"({number}\s*[xX×]\s*{number}(?:\s*[xX×]\s*{number})?)"), F.lit(1))
    plain = lambda m: F.regexp_replace(F.regexp_replace(m, "[.,]", ""), r"\s*[xX×]\s*", " × ")
    return F.aggregate(found, text, lambda acc, m: F.replace(acc, m, plain(m)))


def repaired(text: Column, dictionary: tuple[tuple[str, str], ...], lookalikes: tuple[str, str] = T.LOOKALIKES, ligatures: tuple = T.LIGATURES) -> Column:
    """Scanned text with letters of other scripts as Latin ones, then the dictionary's replacements, longest first (its first entry of each word counts)."""
    out = F.translate(text, *lookalikes)
    for bad, good in ligatures:
        out = F.replace(out, F.lit(bad), F.lit(good))
    entries = sorted({bad: good for bad, good in reversed(dictionary)}.items(), key=lambda x: (-len(x[0]), [b for b, _ in dictionary].index(x[0])))
    if not entries:
        return out
    rows = F.array(*[F.struct(F.lit(b).alias("bad"), F.lit(g).alias("good")) for b, g in entries])
    return F.aggregate(rows, out, lambda acc, x: F.replace(acc, x["bad"], x["good"]))


def brochure_prose(text: Column, names: tuple[str, ...] = ()) -> Column:
    """Brochure text without tables, disclaimers, page numbers, footnotes and headings of tables; names: lines that are only a product's name."""

    def dropped(x: Column, plain: Column) -> Column:
        legal = F.exists(F.array(*map(F.lit, T.DISCLAIMERS)), lambda p: F.contains(plain, p)) | (F.contains(plain, F.lit(T.DISCLAIMER_PAIR[0])) & F.contains(plain, F.lit(T.DISCLAIMER_PAIR[1])))
        page = x.rlike("^[0-9]{1,2}$") & (F.coalesce(x.try_cast("int"), F.lit(99)) <= T.LAST_PAGE)
        out = x.startswith("|") | legal | page | x.rlike(X.U + T.FOOTNOTES) | x.rlike(X.U + T.TABLE_HEADINGS) | x.rlike(X.U + T.HEADING_RESIDUE)
        return out | x.isin(*names) if names else out

    def rest(line: Column) -> Column:
        return F.when(F.contains(line, F.lit("|")), F.btrim(F.replace(F.btrim(line), F.lit("|"), F.lit("")))).otherwise(line)

    # Each form of a line is made once: what a lambda names twice is evaluated twice.
    lines = F.transform(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("was"), F.btrim(x).alias("x"))), lambda s: F.struct(s["was"].alias("was"), s["x"].alias("x"), X.strip_marks(s["x"]).alias("plain")))
    kept = F.filter(lines, lambda s: (s["x"] == "") | ~dropped(s["x"], s["plain"]))
    kept = F.filter(F.transform(kept, lambda s: F.struct(s["was"].alias("was"), rest(s["was"]).alias("now"))), lambda x: ~F.contains(x["was"], F.lit("|")) | (x["now"] != ""))
    return F.array_join(F.transform(kept, lambda x: x["now"]), "\n")


def edition_of(header: Column, series: str) -> Column:
    """What follows the series and its number in a header; empty if nothing does."""
    return F.btrim(F.regexp_extract(header, rf"(?i)^{series}\s*\d+[\s\-]*(.*)$", 1))


def client_address(forwarded: Column, peer: Column) -> Column:
    """The first address of a forwarding header, else the peer's."""
    return F.coalesce(F.btrim(F.get(F.split(F.nullif(forwarded, F.lit("")), ","), F.lit(0))), peer, F.lit("unknown"))


def js_rows(html: Column, name: str, schema: str) -> Column:
    """The array of objects that a script of a page assigns to `name`, parsed as JSON, never run."""
    found = F.regexp_extract(html, rf"(?s)\b{name}\s*=\s*(\[.*?\])\s*;", 1)
    return F.from_json(F.nullif(found, F.lit("")), f"array<struct<{schema}>>")


def question_intent(question: Column, topic: Column) -> Column:
    """What a question wants: the first rule that holds; with a topic it asks for specifications; else it may be out of scope."""
    rest = F.when(topic != "general", "spec_query").when(F.lower(question).rlike("(?s)" + T.OUT_OF_SCOPE), "out_of_scope").otherwise("general")
    out = None
    for label, pattern in T.QUESTION_INTENTS:
        hit = F.lower(F.btrim(question)).rlike("(?s)" + pattern)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(rest)


def broken_rules(answer: Column, rules: Column, decision: Column, evidence: Column) -> Column:
    """Names of the rules (an array of texts) that an answer breaks; only answers are held to them. evidence: how many passages it had."""
    low = F.lower(answer)

    def broken(rule: Column) -> Column:
        names = []
        for name, groups, has, lacks, bare in T.ANSWER_RULES:
            asked = F.lit(True)
            for words in groups:
                one = F.lit(False)
                for w in words:
                    one = one | F.contains(F.lower(rule), F.lit(w))
                asked = asked & one
            bad = (evidence == 0) if bare else low.rlike("(?s)" + has)
            bad = bad & ~low.rlike(lacks) if lacks else bad
            names.append(F.when(asked & bad, F.lit(name)))
        return F.array_compact(F.array(*names))

    return F.when(decision == "answer", F.flatten(F.transform(rules, broken))).otherwise(F.array().cast("array<string>"))


def without_prices(text: Column) -> Column:
    """Amounts with their unit, before or after it and over line breaks, go; so do lines of only an amount or the words around one."""
    amount, unit, stars = T.AMOUNT, T.UNIT, T.STARS
    out = F.regexp_replace(text, rf"(?i)(?:{amount}\s*{stars}\s*{unit}{stars}|{unit}\s*{stars}\s*{amount}{stars})", "")
    alone = rf"(?im)^[ \t]*(?:{amount}|{unit}\\?\*+|{T.PRICE_LEAD})[ \t]*$"
    return F.btrim(F.regexp_replace(F.regexp_replace(out, alone, ""), r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def cut_table(table: str, most: int) -> list[str]:
    rows = table.split("\n")
    header, pieces, held = "\n".join(rows[:2]), [], 0
    for line in rows[2:]:
        held += len(line) + 1
        if not pieces or held > most:
            pieces.append([])
            held = len(line) + 1
        pieces[-1].append(line)
    return ["\n".join([header, *p]).strip(" \n") for p in pieces] or [table]


def table_pieces(table: Column, most: int) -> Column:
    """A table's rows in pieces of at most `most` characters where single rows allow, each under the header's two lines."""

    @F.arrow_udf("array<string>")
    def cut(tables: pa.Array) -> pa.Array:
        # One table at a time is Python's; the pieces of the others are Arrow's.
        made = [pa.array([None] if (t := x.as_py()) is None else cut_table(t, most), pa.string()) for x in tables]
        ends = pa.array([0, *accumulate(map(len, made))], pa.int32())
        return pa.ListArray.from_arrays(ends, pa.concat_arrays(made or [pa.array([], pa.string())]))

    return cut(table)


def fitted_history(messages: Column, most: int) -> Column:
    """Messages (an array of texts) within a token budget: the first and the last stay, and of those between the newest that fit."""
    cost = lambda m: F.greatest(F.lit(1), F.floor(F.length(m) / 4)).cast("long")
    n = F.size(messages)
    ends = cost(F.element_at(messages, 1)) + F.when(n > 1, cost(F.element_at(messages, -1))).otherwise(0)
    middle = F.reverse(F.filter(messages, lambda m, i: (i > 0) & (i < n - 1)))
    start = F.struct(F.array().cast("array<string>").alias("kept"), ends.alias("used"), F.lit(False).alias("full"))

    def step(acc, m):
        full = acc["full"] | (acc["used"] + cost(m) > most)
        return F.struct(F.when(full, acc["kept"]).otherwise(F.array_append(acc["kept"], m)).alias("kept"), F.when(full, acc["used"]).otherwise(acc["used"] + cost(m)).alias("used"), full.alias("full"))

    kept = F.reverse(F.aggregate(middle, start, step, lambda acc: acc["kept"]))
    return F.when(n <= 2, messages).otherwise(F.concat(F.array(F.element_at(messages, 1)), kept, F.array(F.element_at(messages, -1))))


def is_page_junk(section_path: Column, text: Column) -> Column:
    """Boilerplate of a site: by section, by phrase, or, where no section is open, texts of menu items."""
    plain = X.strip_marks(text)
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    menu = F.filter(lines, lambda x: x.rlike(T.MENU_ITEM))
    by_section = F.exists(section_path, lambda p: F.btrim(X.strip_marks(p)).isin(*T.JUNK_SECTIONS))
    by_menu = (F.size(section_path) <= 1) & (((F.size(menu) >= 2) & (2 * F.size(menu) >= F.size(lines))) | plain.rlike(T.LEADING_ITEM))
    return F.coalesce(by_section | plain.rlike("(?s)" + T.JUNK_TEXT) | by_menu, F.lit(False))


def is_of_others(text: Column, model: Column, own: tuple[str, ...], others: tuple[str, ...]) -> Column:
    """Whether a text filed under a model names other brands and neither the model, spaced or not, nor an own brand."""
    low = X.strip_marks(text)
    named = F.contains(low, F.lower(model)) | F.contains(low, F.replace(F.lower(model), F.lit(" "), F.lit("")))
    for brand in own:
        named = named | F.contains(low, F.lit(brand))
    return F.coalesce(~named & F.exists(F.array(*map(F.lit, others)), lambda b: F.contains(low, b)), F.lit(False))


def is_spec_table(text: Column, section_path: Column | None = None) -> Column:
    """Four pipes or more, and a label of specifications; or a section of that title is open."""
    low = X.strip_marks(text)
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    table = (pipes >= 4) & F.exists(F.array(*map(F.lit, T.SPEC_LABELS)), lambda x: F.contains(low, x))
    return table if section_path is None else table | F.exists(section_path, lambda p: F.btrim(X.strip_marks(p)) == T.SPEC_SECTION)


def edition_named(question: Column, editions: tuple = T.EDITIONS) -> Column:
    """The listed edition whose longest name the question has."""
    low, out = F.lower(question), None
    for name, listed in sorted(editions, key=lambda x: -len(x[0])):
        hit = F.contains(low, F.lit(name))
        out = F.when(hit, listed) if out is None else out.when(hit, listed)
    return out


def valid_spec(key: Column, value: Column) -> Column:
    """The value of a specification as it is listed: in its range, or one of the drivetrains; null for anything else."""
    rows = F.create_map(*[x for k, _, _, lo, hi in T.SPEC_RANGES for x in (F.lit(k), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))])
    r, number, wheels = F.try_element_at(rows, key), locale_number(F.btrim(value)), F.upper(F.btrim(value))
    return F.when(key == "drivetrain", F.when(wheels.isin(*T.DRIVETRAINS), wheels)).when((number >= r.lo) & (number <= r.hi), F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string")))


def spec_category(key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, c, *_ in (*T.SPEC_RANGES, ("drivetrain", "powertrain")) for x in (k, c)]), key)


def tool_plan(wants: Column, question: Column, model: Column, models: tuple[str, ...]) -> Column:
    """What is looked up for a question: an array of (tool, model); null where a model must be asked for first."""
    call = lambda tool, m: F.struct(F.lit(tool).alias("tool"), m.cast("string").alias("model"))
    one = lambda tool: F.when(model.isNotNull(), F.array(call(tool, model)))
    none = F.lit(None)
    low, utility = F.lower(question), None
    for tool, pattern in T.UTILITIES:
        utility = F.when(low.rlike(pattern), F.array(call(tool, model))) if utility is None else utility.when(low.rlike(pattern), F.array(call(tool, model)))
    # Every product that the question names, and the one it is about.
    named = F.array_sort(F.array_distinct(F.array_compact(F.concat(models_named(question), F.array(model)))))
    of_each = lambda tool: F.transform(named, lambda m: call(tool, m))
    compared = F.when(low.rlike(T.PRICE_ASKED), F.concat(of_each("get_specs"), of_each("get_price"))).otherwise(of_each("get_specs"))
    return (
        F.when(wants.isin("out_of_scope", "greeting", "thanks", "identity"), F.array().cast("array<struct<tool: string, model: string>>"))
        .when(wants == "utility", utility.otherwise(F.array(call("get_showroom_charging_link", none))))
        .when(wants.isin("price", "versions_list"), one("get_price"))
        .when(wants.isin("spec_query", "feature_presence"), one("get_specs"))
        .when(wants == "cross_model_feature", F.array(*[call("get_specs", F.lit(m)) for m in models]))
        .when(wants == "compare", F.when(F.size(named) > 0, compared))
        .when(wants == "models_list", F.array(call("list_available_models", none)))
        .when(wants == "colors", one("get_colors"))
        .otherwise(F.array(call("search_knowledge_base", model)))
    )


def spec_relevance(question: Column, spec: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """0.9 if a group of words has one in the question and one in the specification, 0.7 if both share a word, else 0.3."""
    q, s = X.tokens(question, ()), X.tokens(spec, ())
    rows = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    return F.when(F.exists(rows, lambda g: F.arrays_overlap(g, q) & F.arrays_overlap(g, s)), 0.9).when(F.arrays_overlap(q, s), 0.7).otherwise(0.3)
