"""Rank-synchronous merging of byte-pair symbols over ragged numpy arrays.

All sequences of a batch lie in one flat array. In every round each unfinished sequence applies its
own lowest-rank pair, at all its places at once where that is what one merge after the other, leftmost
first, comes to: places don't overlap, and no merge there can make way for a lower rank before the
others had their turn. Pairs whose symbol begins or ends a pair of lower rank are applied at places so
far apart that the symbols which grow there can't touch. The rounds of different sequences run side by
side. Sequences whose symbols allow no more merge leave the arrays.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Longer sequences, in symbols, use `Merger.one`, by the same rule: a pathological one could need a round per merge.
LONG = 50_000
_NONE = np.int64(1 << 40)


class Merger:
    """pairs: {(left symbol, right symbol): (rank, merged symbol)}; symbols are below 2^20. widest: the most first symbols that one symbol is merged of."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], widest: int):
        self.pairs, self.apart = pairs, 2 * widest
        least: dict[int, int] = {}
        for (a, b), (r, _) in pairs.items():
            least[a], least[b] = min(r, least.get(a, r)), min(r, least.get(b, r))
        keys = np.array([a << 20 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(1 << 62))
        # Ranks times two, and one where the merge may let a pair of lower rank come up.
        values = np.array([(2 * r + (least.get(c, r + 1) <= r), c) for r, c in pairs.values()], np.int64).reshape(-1, 2)[order]
        self.rank, self.made = np.append(values[:, 0], _NONE), np.append(values[:, 1], 0)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NONE), np.where(hit, self.made[at], 0)

    def run(self, sequences: list[list[int]]) -> list[np.ndarray]:
        """The symbols that remain of each sequence."""
        short = [i for i, s in enumerate(sequences) if len(s) <= LONG]
        lens = np.array([len(sequences[i]) for i in short], np.int64)
        sym, left = self.run_flat(np.fromiter((x for i in short for x in sequences[i]), np.int64, lens.sum()), lens)
        out: list = [None] * len(sequences)
        for i, part in zip(short, np.split(sym, np.cumsum(left)[:-1])):
            out[i] = part
        for i, s in enumerate(sequences):
            if len(s) > LONG:
                out[i] = np.array(self.one(s), np.int64)
        return out

    def run_flat(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What remains of sequences of these lengths, which follow each other in `sym`; and how long each then is."""
        finished: list[tuple[np.ndarray, np.ndarray]] = []  # symbols, and the sequence of each
        row = np.repeat(np.arange(len(lens)), lens)
        rank, made = self._look(sym[:-1], sym[1:])
        rank, made = np.append(rank, _NONE), np.append(made, 0)
        rank[:-1][row[1:] != row[:-1]] = _NONE
        while len(sym):
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            now = np.diff(np.append(starts, len(row)))
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            if done.any():
                stay = np.repeat(~done, now)
                finished.append((sym[~stay], row[~stay]))
                sym, row, rank, made = sym[stay], row[stay], rank[stay], made[stay]
                least, now = least[~done], now[~done]
                if not len(sym):
                    break
            # Ranks that differ in the mark alone are one rank.
            at = np.flatnonzero(rank >> 1 == np.repeat(least >> 1, now))
            gap = np.append(_NONE, np.diff(at))
            gap[np.append(True, row[at][1:] != row[at][:-1])] = _NONE
            places = np.arange(len(at))
            run = places - np.maximum.accumulate(np.where(gap > 1, places, 0))
            shaky = np.zeros(int(row[-1]) + 1, bool)
            shaky[row[at[rank[at] & 1 == 1]]] = True
            at = at[np.where(shaky[row[at]], gap > self.apart, run % 2 == 0)]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, row, rank, made = sym[keep], row[keep], rank[keep], made[keep]
            at -= np.arange(len(at))
            for spots in (at, at[at > 0] - 1):
                inner = spots[spots + 1 < len(sym)]
                rank[spots] = _NONE
                same = inner[row[inner] == row[inner + 1]]
                rank[same], made[same] = self._look(sym[same], sym[same + 1])
        left, rows = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*finished)) if finished else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return left[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(lens))

    def one(self, s: list[int]) -> list[int]:
        """The same for one long sequence, with a queue: O(n log n)."""
        sym, after, before = list(s), list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        queue = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(sym) and (found := self.pairs.get((sym[i], sym[after[i]]))):
                heapq.heappush(queue, (found[0], i, sym[i], sym[after[i]], found[1]))

        for i in range(len(sym) - 1):
            offer(i)
        while queue:
            _, i, a, b, c = heapq.heappop(queue)
            j = after[i]
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = c, -1, after[j]
            if after[i] < len(sym):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [x for x in sym if x >= 0]
