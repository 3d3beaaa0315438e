"""Column functions on a turn of a conversation: what it names, what it is about, and what is done about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from . import tables as T
from .products import model_named
from .questions import question_intent


def edition_first(text: Column) -> Column:
    """The listed edition that the first name of one in a text stands for."""
    found = F.regexp_extract(F.lower(text), f"({T.EDITION_NAMES})", 1)
    listed = F.create_map(*[F.lit(x) for name in T.EDITIONS for x in name])
    return F.element_at(listed, found)


def topic(text: Column) -> Column:
    return rules.first_match(text, T.TOPICS, "general")


def named(text: Column) -> dict[str, Column]:
    """What a turn itself says: model, edition and topic, null where it says nothing of one."""
    return {"model": model_named(text), "edition": edition_first(text), "topic": F.nullif(topic(text), F.lit("general"))}


def decided(text: Column, model: Column, topic_: Column) -> dict[str, Column]:
    """intent, spec_group, spec_key, decision, reason, fallback and tools of a turn, given its (or inherited) model and topic; a null topic is general."""
    about = F.coalesce(topic_, F.lit("general"))
    ruled = question_intent(text, about)
    group = rules.first_match(text, T.SPEC_GROUPS, None)
    intent = F.when((ruled == "general") & group.isNotNull(), "spec_query").otherwise(ruled)
    missing = model.isNull()
    respond, pointing = intent.isin("greeting", "thanks", "identity"), F.lower(text).rlike(T.POINTING)
    unclear, lacking = missing & pointing, missing & ~intent.isin(*T.WITHOUT_MODEL)
    cases = lambda a, b, c, d, e: F.when(respond, a).when(intent == "out_of_scope", b).when(unclear, c).when(lacking, d).otherwise(e)
    answers = ~respond & (intent != "out_of_scope") & ~unclear & ~lacking
    tools = None
    for name, allowed in T.TOPIC_TOOLS:
        made = F.array(*map(F.lit, allowed))
        tools = F.when(about == name, made) if tools is None else tools.when(about == name, made)
    return {
        "intent": intent,
        "spec_group": F.when(answers & intent.isin(*T.WITH_GROUP), group),
        "spec_key": F.when(answers & intent.isin(*T.WITH_KEY), rules.first_match(text, T.SPEC_KEYS, None)),
        "decision": cases("respond", "out_of_scope", "clarify", "clarify", "answer"),
        "reason": cases(intent, "out_of_scope", "ambiguous_context", "missing_model", "sufficient_direct_evidence"),
        "fallback": answers & (intent == "general") & (~missing | (F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))) >= 4)),
        "tools": F.when(answers, tools),
    }
