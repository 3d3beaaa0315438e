"""Scanned text put right by a dictionary of any size: one pass of an automaton finds which entries a text has at all.

The result is that of replacing entry after entry, the longest first, over the whole text. Only entries
that occur are replaced, and after each of them only the neighbourhoods of what changed are searched again:
the work grows with the text and its mistakes, not with the dictionary.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import tables as T

#: What stands for a character that couldn't be read, in texts and in the dictionary of contexts; what is left of it goes.
UNREADABLE, MARK = "�", "@@"


def _first_of(entries: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    out: dict[str, str] = {}
    for bad, good in entries:
        out.setdefault(bad, good)
    return list(out.items())


class Replacer:
    """entries: (bad, good), applied in this order; of entries that repeat a bad the first counts."""

    def __init__(self, entries: Iterable[tuple[str, str]]):
        self.entries = [(b, g) for b, g in _first_of(entries) if b]
        self.widest = max((len(b) for b, _ in self.entries), default=0)
        self.automaton = ahocorasick.Automaton()
        for i, (bad, _) in enumerate(self.entries):
            self.automaton.add_word(bad, i)
        if self.entries:
            self.automaton.make_automaton()

    def _found(self, text: str) -> set[int]:
        return {i for _, i in self.automaton.iter(text)}

    def apply(self, text: str) -> str:
        if not self.entries:
            return text
        known = self._found(text)
        queue = sorted(known)
        while queue:
            k = heapq.heappop(queue)
            bad, good = self.entries[k]
            parts = text.split(bad)
            if len(parts) == 1:
                continue
            text = good.join(parts)
            at = 0
            reach = self.widest - 1
            last = (0, 0)
            for p in parts[:-1]:  # neighbourhoods of the places, those that overlap as one
                at += len(p)
                low, high = max(0, at - reach), at + len(good) + reach
                if low > last[1]:
                    self._search(text[slice(*last)], k, known, queue)
                    last = (low, high)
                last = (last[0], high)
                at += len(good)
            self._search(text[slice(*last)], k, known, queue)
        return text

    def _search(self, piece: str, after: int, known: set[int], queue: list[int]) -> None:
        for i in self._found(piece) - known if piece else ():
            if i > after:
                known.add(i)
                heapq.heappush(queue, i)


def longest_first(entries: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Stable; of entries that repeat a bad the first counts."""
    return sorted(_first_of(entries), key=lambda e: -len(e[0]))


_MADE: dict[str, tuple[Replacer, Replacer]] = {}


def repairer(spark: SparkSession, dictionary: Iterable[tuple[str, str]], contexts: Iterable[tuple[str, str]] = ()) -> Callable[[Column], Column]:
    """A column function: look-alike letters and ligatures as Latin ones, contexts of unreadable characters (with MARK for one, in their
    order), then the dictionary, longest first. Both are broadcast; nulls stay null."""
    first, then = list(contexts), longest_first(dictionary)
    held = spark.sparkContext.broadcast((first, then))
    key = hashlib.md5(repr((first, then)).encode()).hexdigest()

    @F.arrow_udf("string")
    def repair(texts: pa.Array) -> pa.Array:
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = tuple(map(Replacer, held.value))
        marks, words = _MADE[key]

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            if UNREADABLE in text or MARK in text:
                text = marks.apply(text.replace(UNREADABLE, MARK)).replace(MARK, "")
            return words.apply(text.replace("&amp;", "&"))

        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    def column(text: Column) -> Column:
        out = F.translate(text, *T.LOOKALIKES)
        for bad, good in T.LIGATURES:
            out = F.replace(out, F.lit(bad), F.lit(good))
        return repair(out)

    return column
