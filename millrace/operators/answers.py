"""What stands behind an answer: ranked chunks, citations by address, links to sources, a log of the decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables as T
from ..sources.store import cut
from . import retrieval as R

MOST_CHUNKS, LEAST_SCORE = 30, 0.3


def ranked_chunks(chunks: DataFrame, by: list[str], order: list[str], most: int = MOST_CHUNKS, least: float = LEAST_SCORE) -> DataFrame:
    """The best chunks (by, score, order columns) of each question with `rank`; ties in the given order."""
    best = Window.partitionBy(*by).orderBy(F.desc("score"), *order)
    return chunks.where(F.col("score") >= least).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def firsts(rows: DataFrame, by: list[str], pos: str, most: int, name: str = "ids") -> DataFrame:
    """(by, name): the first `most` positions of each group, in order."""
    order = Window.partitionBy(*by).orderBy(pos)
    first = rows.select(*by, pos).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return first.groupBy(*by).agg(F.array_sort(F.collect_list(pos)).alias(name))


def first_matches(asked: DataFrame, told: DataFrame, by: str, pos: str, name: str, most: int = MOST_CHUNKS) -> DataFrame:
    """(q, name): of the rows (by, pos, t) in a question's group that share a word with it the first `most`; asked: (q, by, token).

    They are among the first `most` of each of its words, so no question meets all rows of its group.
    """
    known = asked.select("token").distinct()
    words = told.select(by, pos, F.explode("t").alias("token"))
    words = words.join(F.broadcast(known), "token", "left_semi") if known.limit(R.BROADCAST_ROWS + 1).count() <= R.BROADCAST_ROWS else words
    met = asked.join(firsts(words, [by, "token"], pos, most), [by, "token"])
    return met.groupBy("q").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias(name))


def most_shared(asked: DataFrame, told: DataFrame, by: str, pos: str, name: str, score: Callable[[Column], Column], most: int = MOST_CHUNKS) -> DataFrame:
    """(q, name): of the same rows the best `most` as (-score, pos), by the score that a number of shared words gives; ties to smaller positions.

    Rows with the same words are one kind. A question meets kinds by their words; its best rows are in its best `most` kinds.
    """
    kinds = cut(firsts(told.withColumn("kind", F.array_sort("t")), [by, "kind"], pos, most).select(by, F.monotonically_increasing_id().alias("id"), "kind", "ids"))
    words = kinds.select(by, "id", F.get("ids", F.lit(0)).alias("first"), F.explode("kind").alias("token"))
    shared = asked.join(words, [by, "token"]).groupBy("q", "id", "first").agg((-score(F.count("*"))).alias("s"))
    best = shared.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy("s", "first"))).where(F.col("_n") <= most)
    each = best.join(kinds.select("id", "ids"), "id").select("q", F.transform("ids", lambda x: F.struct(F.col("s"), x.alias("pos"))).alias("l"))
    return each.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, most).alias(name))


def _pages(pages: Column) -> Column:
    """Page labels by number; labels that aren't numbers come first."""
    keyed = F.transform(pages, lambda p: F.struct(F.coalesce(F.when(p.rlike("^[0-9]+$"), p.try_cast("int")), F.lit(0)).alias("n"), p.alias("p")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x.p), ", ")


def displayed(citations: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by, citation_id, text, url, chunk_ids, pages): citations (by, pos, url, model, label), one for each address, the first one counts.

    Chunks (by, rank, url, chunk_id, page) are grouped by address before they meet the citations.
    """
    listed = chunks.where("coalesce(url, '') <> '' AND coalesce(chunk_id, '') <> ''").groupBy(*by, "url", "chunk_id").agg(F.min("rank").alias("rank"))
    ids = listed.groupBy(*by, "url").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("c"))
    pages = chunks.where("coalesce(url, '') <> '' AND coalesce(page, '') <> ''").groupBy(*by, "url").agg(F.collect_set("page").alias("p"))
    first = citations.where("coalesce(url, '') <> ''").groupBy(*by, "url").agg(F.min(F.struct("pos", "model", "label")).alias("first"))
    rows = first.join(ids, [*by, "url"], "left").join(pages, [*by, "url"], "left").select(*by, "url", "first.*", F.coalesce(F.transform("c", lambda x: x.chunk_id), F.array().cast("array<string>")).alias("chunk_ids"), F.coalesce(_pages(F.col("p")), F.lit("")).alias("pages"))
    number = F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    name = F.when(some("model") & some("label"), F.concat("model", F.lit(" — "), "label")).when(some("label"), F.col("label")).otherwise(F.col("url"))
    text = F.when(F.col("pages") != "", F.concat(name, F.lit(" (trang "), "pages", F.lit(")"))).otherwise(name)
    return rows.select(*by, F.concat(F.lit("cit_"), F.lpad(number.cast("string"), 3, "0")).alias("citation_id"), text.alias("text"), "url", "chunk_ids", "pages")


#: Results of these come first among the links to sources, in this order.
LINK_ORDER = ("get_specs", "get_price", "get_colors", "search_knowledge_base")


def source_links(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, links) of results (by, pos, tool, url, name): every address once, by kind of lookup and then by place, as one text."""
    kind = F.array_position(F.array(*map(F.lit, LINK_ORDER)), F.col("tool"))
    place = F.struct(F.when(kind > 0, kind).otherwise(len(LINK_ORDER) + 1).alias("kind"), "pos", "name")
    first = results.where("coalesce(url, '') <> ''").groupBy(*by, "url").agg(F.min(place).alias("place"))
    each = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place.kind", "place.pos", "place.name", "url"))).alias("l"))
    return each.select(*by, F.array_join(F.transform("l", lambda x: F.concat(F.lit("["), F.coalesce(x["name"], F.lit("")), F.lit("]("), x.url, F.lit(")"))), ", ").alias("links"))


def request_rows(payloads: DataFrame, model: str, version: str = "v1.0.0") -> DataFrame:
    """Rows of the request table from payloads: the question cut to 500 characters, defaults where a field is missing, ids that aren't UUIDs as none."""
    is_id = F.col("session_id").rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
    return payloads.withColumns(
        {
            "session_id": F.when(is_id, F.col("session_id")),
            "query_text": F.substring(F.coalesce("query_text", F.lit("")), 1, 500),
            "model_used": F.coalesce(F.nullif("model_used", F.lit("")), F.lit(model)),
            "prompt_version": F.coalesce(F.nullif("prompt_version", F.lit("")), F.lit(version)),
            "tools_used": F.to_json(F.coalesce("tools_used", F.array().cast("array<string>"))),
        }
    )


def touched(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions (session_id, turn_count, last_message, updated_at, summary) after turns (session_id, at, message): counts grow, new ones begin; summaries stay as they are."""
    new = turns.groupBy("session_id").agg(F.count("*").alias("n"), F.max_by("message", "at").alias("message"), F.max("at").alias("at"))
    rows = sessions.join(new, "session_id", "full_outer")
    return rows.select(
        "session_id",
        (F.coalesce("turn_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("turn_count"),
        F.when(F.col("n").isNotNull(), F.col("message")).otherwise(F.col("last_message")).alias("last_message"),
        F.coalesce("at", "updated_at").alias("updated_at"),
        "summary",
    )


def api_metrics(calls: DataFrame) -> DataFrame:
    """(op, model, latency_ms, ttft_ms, input_tokens, output_tokens, at) of calls (op, model, begun, ended, first, response): tokens from the response's usage under either of its names."""
    usage = F.from_json(F.get_json_object("response", "$.usage"), "input_tokens long, prompt_tokens long, output_tokens long, completion_tokens long")
    ms = lambda c: F.round((F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.col("begun").cast("timestamp"))) / 1000, 1)
    either = lambda a, b: F.coalesce(F.nullif(F.col(f"u.{a}"), F.lit(0)), F.col(f"u.{b}"))
    return calls.withColumn("u", usage).select("op", "model", ms("ended").alias("latency_ms"), ms("first").alias("ttft_ms"), either("input_tokens", "prompt_tokens").alias("input_tokens"), either("output_tokens", "completion_tokens").alias("output_tokens"), F.date_format("begun", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


def raw_route(url: Column, kind: Column, name: Column, model: Column, official: tuple[str, ...]) -> Column:
    """(collection, category, confidence, authoritative, kind) of a raw file by ordered rules on its address, kind and name."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "https?://([^/]+)", 1))
    own = host.isin(*official)
    texts = {"url": F.coalesce(url, F.lit("")), "name": F.lower(name)}
    out = None
    for of_host, of_kind, of_model, place, pattern, collection, category, confidence, what in T.RAW_ROUTES:
        hit = F.lit(True)
        for asked, holds in ((of_host, own), (of_kind, kind == of_kind), (of_model, model.isNotNull())):
            hit = hit & holds if asked else hit
        if pattern:
            either = texts["name"].rlike(pattern) | F.lower(texts["url"]).rlike(pattern)
            hit = hit & (either if place == "either" else texts[place].rlike(pattern))
        made = F.struct(F.lit(collection).alias("collection"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), own.alias("authoritative"), F.lit(what).alias("kind"))
        out = F.when(hit, made) if out is None else out.when(hit, made)
    return out
