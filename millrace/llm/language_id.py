"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over a bounded sample of its labelled text. A text is cut,
greedily, into the longest phrases that occur in the sample (a character that doesn't occur is a
phrase); phrases times log2(sample length) over the text's length estimates the cross entropy. The
language with the fewest such normalised phrases wins, ties to the smaller name.

The automata of all languages are one table of transitions; numpy steps many stretches of text
through it at once. Each stretch is first parsed from its start; then the parse that really enters it
from the stretch before is followed until it meets that one, from where on they agree. So texts of any
length are parsed whole, as one sequence of phrases. Upper case counts as lower case; digits, ASCII
symbols and spaces count as one gap.

Defined results: null texts and texts without a letter (Unicode's category L) are `und` with score 0, as
is everything if no language could be learned; repeated rows get a row each; an empty table gives no
rows; columns of any other name pass through or are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Bounds of the training sample: documents and characters per language, and languages (the fit only; predictions read whole texts).
SAMPLE_DOCS, SAMPLE_CHARS, MOST_LANGUAGES = 48, 40_000, 64
STRETCH = 1024
_GAP = np.ones(256, bool)
_GAP[128:] = False
_GAP[97:123] = False


def _plain(text: str) -> np.ndarray:
    """UTF-8 bytes of the lower-cased text with every run of other than letters as one space."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    gap = _GAP[b]
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    return np.where(gap, np.uint8(32), b)[keep]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; 0 is the root. A string can be walked from it if it occurs in codes."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return moves


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class CrossParser:
    """samples: {language: text}."""

    def __init__(self, samples: dict[str, str]):
        plain = {k: _plain(v) for k, v in sorted(samples.items())}
        self.languages = [k for k, v in plain.items() if len(v)]
        self.code = np.zeros((len(self.languages), 256), np.int32)  # by language; 0: a byte that its sample lacks
        self.bits, self.roots, blocks, base = [], [], [], 0
        for code, k in zip(self.code, self.languages):
            used = np.unique(plain[k])
            code[used] = np.arange(1, len(used) + 1)
            wide = len(used) + 1
            moves = suffix_automaton(code[plain[k]].tolist())
            kind = np.int32 if base + (len(moves) + 1) * wide < 2**31 else np.int64
            restart = np.full(wide, base + len(moves) * wide, kind)  # after a byte that the sample lacks, any move is missing
            for c, s in moves[0].items():
                restart[c] = base + s * wide
            block = np.tile(~restart, (len(moves) + 1, 1))  # a missing move: the complement of where the next phrase begins
            block[0] = restart
            for s, m in enumerate(moves):
                for c, t in m.items():
                    block[s, c] = base + t * wide
            blocks.append(block.ravel())
            self.roots.append(base)
            self.bits.append(np.log2(max(2, len(plain[k]))))
            base += block.size
        self.table = np.concatenate(blocks) if blocks else np.zeros(0, np.int32)

    def phrases(self, texts: list[np.ndarray], stretch: int = STRETCH) -> np.ndarray:
        """(texts, languages): into how many phrases each text falls."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        sizes = np.array([len(t) for t in texts])
        if not len(self.languages) or not sizes.sum():
            return out
        owner = np.repeat(np.arange(len(texts)), -(-sizes // stretch))
        first = np.concatenate([np.arange(0, n, stretch) for n in sizes])
        begin = first + (np.cumsum(sizes) - sizes)[owner]
        length = np.minimum(stretch, sizes[owner] - first)
        codes = self.code.take(np.append(np.concatenate(texts), np.zeros(stretch, np.uint8)), axis=1)

        order = np.argsort(-length, kind="stable")
        active = np.searchsorted(-length[order], -np.arange(length.max()), side="left")
        roots = np.array(self.roots, self.table.dtype)[:, None]
        state = np.repeat(roots, len(owner), axis=1)
        ended = np.zeros(state.shape, self.table.dtype)
        at = begin[order]
        for t in range(length.max()):
            n = active[t]
            to = self.table.take(state[:, :n] + codes.take(at[:n] + t, axis=1))
            miss = to >> (8 * to.itemsize - 1)
            ended[:, :n] -= miss
            state[:, :n] = to ^ miss
        back = np.argsort(order, kind="stable")
        state, ended = state[:, back], ended[:, back]

        # Stretches that continue a text: what they are entered with is first taken to be the end of a parse from the start of the
        # stretch before, and followed again where that turns out to be another state.
        real, counts = state.copy(), ended.copy()
        lang, k = np.nonzero(np.broadcast_to(first > 0, state.shape))
        while len(k):
            end, counts[lang, k] = self._follow(real[lang, k - 1], roots[lang, 0], state[lang, k], ended[lang, k], codes, lang, begin[k], length[k])
            other = (end != real[lang, k]) & (np.append(first, 0)[k + 1] > 0)
            real[lang, k] = end
            lang, k = lang[other], k[other] + 1
        np.add.at(out, owner, counts.T)
        return out + (sizes > 0)[:, None]

    def _step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.table[state + codes]
        return np.where(to < 0, ~to, to), to < 0

    def _follow(self, entered, root, root_end, root_count, codes, lang, begin, length) -> tuple[np.ndarray, np.ndarray]:
        """(end states, phrase ends) of stretches entered in some state, given those of a parse from the root."""
        end, count = entered.copy(), np.zeros(len(entered), np.int32)
        lane, x, y = np.arange(len(entered)), entered, root
        seen = np.zeros(len(entered), np.int32)  # phrase ends of the parse from the root, so far
        t = 0
        while len(lane):
            c = codes[lang[lane], begin[lane] + t]
            (x, x_miss), (y, y_miss) = self._step(x, c), self._step(y, c)
            count[lane] += x_miss
            seen[lane] += y_miss
            t += 1
            met, over = x == y, length[lane] == t
            done = lane[met]
            end[done], count[done] = root_end[done], count[done] + root_count[done] - seen[done]
            end[lane[over & ~met]] = x[over & ~met]
            go = ~met & ~over
            lane, x, y = lane[go], x[go], y[go]
        return end, count

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, k = [], 0
        while k < len(texts):
            part, total = [], 0
            while k < len(texts) and total < 4_000_000:
                t = texts[k] if texts[k] and has_letter(texts[k]) else ""
                part.append(_plain(t))
                total += len(part[-1])
                k += 1
            n = self.phrases(part)
            rate = n * np.array(self.bits) / np.maximum(1, [[len(p)] for p in part])
            for p, r in zip(part, rate):
                if not len(p) or not len(self.languages):
                    out.append(("und", 0.0))
                    continue
                best = int(r.argmin())
                rest = np.delete(r, best)
                out.append((self.languages[best], float(1 - r[best] / rest.min()) if len(rest) else 1.0))
        return out


def samples(labelled: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, languages: int = MOST_LANGUAGES) -> dict[str, str]:
    """Per language whole distinct texts in the order of their hashes, at most `docs` with `chars` characters in all.

    Texts beyond an eighth of that come after all others, ones beyond `chars` aren't learned from; of more languages than
    `languages` those with the most characters chosen are learned.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), F.length("text").alias("n"), "text").where((F.col("n") > 0) & (F.col("n") <= chars))
    # First among a 64th of each language, so that no language is one task, then among what is left of it.
    chosen = rows.select("lang", "h", "n", (F.col("n") > chars // 8).alias("long")).distinct()
    for by in (["lang", F.pmod("h", F.lit(64))], ["lang"]):
        chosen = chosen.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("long", "h"))).where(F.col("place") <= docs)
    chosen = common.cut(chosen.withColumn("total", F.sum("n").over(Window.partitionBy("lang").orderBy("place"))).where(F.col("total") <= chars).select("lang", "h", "n"))
    most = chosen.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    chosen = chosen.join(F.broadcast(most), "lang", "left_semi").drop("n")
    out: dict[str, list] = {}
    for r in sorted(rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()):
        out.setdefault(r.lang, []).append(r.text)
    return {k: "\n".join(v) for k, v in out.items()}


def identify(docs: DataFrame, texts: dict[str, str], keep_text: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' columns (the text only if asked for), less any of these names, with the predicted language and the score."""
    model = ("parser", hashlib.md5(repr(sorted(texts.items())).encode("utf-8", "surrogatepass")).hexdigest())
    kept = [f for f in docs.schema.fields if f.name not in names and (f.name != "text" or keep_text)]
    docs = docs.select(*[f"`{f.name}`" for f in kept if f.name != "text"], "text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = common.only_model(model, lambda: CrossParser(texts))
        for b in batches:
            got = parser.predict(b.column("text").to_pylist())
            new = [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *new], names=[*[f.name for f in kept], *names])

    types = [*[(f.name, f.dataType.simpleString()) for f in kept], (names[0], "string"), (names[1], "double")]
    return common.in_batches(docs, predict, ", ".join(f"`{n}` {t}" for n, t in types), model)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from documents outside the held-out quarter."""
    docs = common.table(spark, sf_dir, "documents")
    held = common.held_out(F.col("doc_id"), 4, 2)
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), samples(docs.where(~held)))
