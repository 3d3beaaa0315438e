"""Questions into lookups: history, classification inputs, plans, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HISTORY_MESSAGES, HISTORY_TOKENS = 14, 30_000
CAPS = {"user": 4_000, "assistant": 16_000}
#: What is looked up for an intent; one that isn't here needs nothing.
PLANS = {
    "price": ("get_price",),
    "spec_query": ("get_specs", "search_knowledge_base"),
    "feature_presence": ("get_specs",),
    "cross_model_feature": ("get_specs",),
    "compare": ("get_specs", "get_price"),
    "versions_list": ("get_price",),
    "models_list": ("list_available_models",),
    "colors": ("get_colors",),
    "policy": ("search_knowledge_base",),
    "general": ("search_knowledge_base",),
}


def inherited(turns: DataFrame, column: str) -> DataFrame:
    """Each turn's value, or the latest that an earlier turn of the conversation has."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn(f"{column}_ctx", F.last(column, ignorenulls=True).over(so_far))


def sanitized(turns: DataFrame) -> DataFrame:
    """User and assistant turns; of runs of one role the newest; no assistant first, no user last; texts capped."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.where(F.col("role").isin(*CAPS)).withColumn("_next", F.lead("role").over(by)).where("_next IS NULL OR _next <> role")
    rows = rows.withColumns({"_first": F.row_number().over(by), "_last": F.lead("turn").over(by)})
    rows = rows.where(~((F.col("_first") == 1) & (F.col("role") == "assistant")) & ~(F.col("_last").isNull() & (F.col("role") == "user")))
    text = F.col("text")
    capped = None
    for role, most in CAPS.items():
        long = (F.col("role") == role) & (F.length(text) > most)
        made = F.concat(F.substring(text, 1, most), F.lit("…"))
        capped = F.when(long, made) if capped is None else capped.when(long, made)
    return rows.withColumn("text", capped.otherwise(text)).drop("_next", "_first", "_last")


def recent(turns: DataFrame, tokens: Column, messages: int = HISTORY_MESSAGES, budget: int = HISTORY_TOKENS) -> DataFrame:
    """The last messages of each conversation, as far as their tokens fit the budget."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumns({"_n": F.row_number().over(newest), "_tokens": F.sum(tokens).over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    return rows.where((F.col("_n") <= messages) & (F.col("_tokens") <= budget)).drop("_n", "_tokens")


def plan(intent: Column) -> Column:
    """The tools of an intent, in order."""
    out = None
    for name, tools in PLANS.items():
        made = F.array(*map(F.lit, tools))
        out = F.when(intent == name, made) if out is None else out.when(intent == name, made)
    return out.otherwise(F.array().cast("array<string>"))


def overlap_score(shared: Column) -> Column:
    """0.3 and a tenth per shared token, 0.9 at most; 0 without any."""
    return F.when(shared > 0, F.least(F.lit(0.9), 0.3 + 0.1 * shared)).otherwise(F.lit(0.0))


def evidence_class(score: Column, direct: float = 0.5, partial: float = 0.2) -> Column:
    return F.when(score >= direct, "direct").when(score >= partial, "partial").otherwise("none")
