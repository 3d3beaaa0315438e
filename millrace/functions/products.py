"""Products that a text names, of a series with numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


def model_pattern(series: str) -> str:
    return rf"{series}\s*[0-9]+(?:\s*{T.RENEWED})?|{series}\s*mpv\s*[0-9]+|{series}\s*e34"


def listed(found: Column, series: str = "mk", renewed: str = "8") -> Column:
    """A name as it was found, as it is listed: MK 6, MK MPV 7, MK E34; a name with "new" is the renewed number's; null for none."""
    number = F.regexp_extract(found, rf"^{series}\s*([0-9]+)", 1)
    name = series.upper()
    return (
        F.when(found == "", None)
        .when((number != "") & found.rlike("new|mới|moi"), F.lit(f"{name} {renewed} All New"))
        .when(number != "", F.concat(F.lit(f"{name} "), number))
        .when(found.rlike("mpv"), F.concat(F.lit(f"{name} MPV "), F.regexp_extract(found, "([0-9]+)$", 1)))
        .otherwise(F.lit(f"{name} E34"))
    )


def model_named(text: Column, series: str = "mk", renewed: str = "8") -> Column:
    """The first product of a series that a text names."""
    return listed(F.regexp_extract(F.lower(text), f"({model_pattern(series)})", 1), series, renewed)


def models_named(text: Column, series: str = "mk", renewed: str = "8") -> Column:
    """All of them, in the order of the text."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({model_pattern(series)})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: listed(x, series, renewed)))
