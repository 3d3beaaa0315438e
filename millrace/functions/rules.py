"""Ordered rule tables as data, compiled to one CASE expression: the first rule that matches wins.

The tables themselves are in `tables.py`; others are passed the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REASONS = (("timeout", "timed_out"), ("time", "slow"), ("error", "system_error"), ("purchase", "sold"), ("sign", "signed"))


def first_match(text: Column, rules: tuple, default: str | None) -> Column:
    out = None
    low = F.lower(text)
    for label, pattern in rules:
        hit = low.rlike("(?s)" + pattern)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def longest_key(text: Column, rules: tuple, default: str | None) -> Column:
    """The value of the longest key that the text contains; ties go to the earlier rule."""
    out = None
    for key, value in sorted(rules, key=lambda r: -len(r[0])):
        hit = F.contains(text, F.lit(key))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.lit(default))
