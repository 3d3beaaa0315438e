"""Column functions on numbers: prices of requests, percentages, similarities, locale numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prices in hundredths of a dollar per million tokens, (name part, input, output), tried in order; then the default.
PRICES = (("alpha-large", 250, 1000), ("alpha-small", 15, 60), ("beta", 125, 500))
DEFAULT_PRICE = (50, 150)
VND_PER_USD = 25_400


def _price(model: Column, which: int) -> Column:
    out = None
    for name, *prices in PRICES:
        hit = F.lower(model).contains(name)
        out = F.when(hit, prices[which]) if out is None else out.when(hit, prices[which])
    return out.otherwise(DEFAULT_PRICE[which])


def cost_micro_usd(model: Column, prompt: Column, completion: Column) -> Column:
    """Millionths of a dollar, rounded half up; exact integer arithmetic."""
    hundredths = prompt * _price(model, 0) + completion * _price(model, 1)
    return F.floor((hundredths + 50) / 100).cast("long")


def cost_vnd_cents(micro_usd: Column) -> Column:
    return F.floor((micro_usd * (VND_PER_USD // 100) + 50) / 100).cast("long")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """part of whole in percent; 0 where the whole is 0."""
    return F.when(whole > 0, F.round(part / whole * 100.0, digits)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Between 0 and 1; 0 if either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norms))).otherwise(F.lit(0.0))


def rrf(rank: Column, k: int = 60) -> Column:
    """Reciprocal rank, as rank fusion adds up."""
    return 1.0 / (k + rank)


def locale_number(text: Column) -> Column:
    """A number with `.` or `,` for thousands or decimals: three digits after every separator mean thousands."""
    plain = F.regexp_replace(text, r"\s", "")
    grouped = plain.rlike(r"^\d{1,3}([.,]\d{3})+$")
    return F.when(grouped, F.regexp_replace(plain, "[.,]", "").try_cast("double")).otherwise(F.regexp_replace(plain, ",", ".").try_cast("double"))
