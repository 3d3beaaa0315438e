"""Query keys of the engine's own operators: key -> Spark function, and key -> oracle SQL."""

from __future__ import annotations

from .plans import answers, brochures, catalog, corpus, decisions, evaluation, helpers, pages, questions, records, retrieval, routing, sheets, state, stores, telemetry, versions
from .plans.base import ORACLES, QUERIES

FLAGSHIP = "tel_overview"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "answers", "brochures", "catalog", "corpus", "decisions", "evaluation", "helpers", "pages", "questions", "records", "retrieval", "routing", "sheets", "state", "stores", "telemetry", "versions"]
