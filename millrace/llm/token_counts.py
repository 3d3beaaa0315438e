"""Token counts of whole texts under a sentencepiece BPE model, by rank-synchronous array merging.

A text is cut into pre-tokens (a run of word marks with the characters up to the next mark, and
within that wherever a character occurs in no piece of two or more characters, or two neighbours in
none), between which no merge can happen. The distinct pre-tokens of a batch are held as ragged numpy arrays and merged
together; the surviving symbols are counted, characters outside the vocabulary as their bytes.

Defined results: null and empty texts have 0 bytes and 0 tokens; strings like "<s>" are ordinary
text; repeated rows are counted each; an empty table gives no rows; texts of any length are counted
whole. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .merging import Merger

MARK = "▁"
#: Characters of distinct pre-tokens that a Python worker remembers; then it starts afresh. Longer pre-tokens are also cut between neighbours.
REMEMBERED, CUT_FROM = 4_000_000, 16


class PieceCounter:
    """Counts tokens as the sentencepiece model at `path` does."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = {i for i in range(sp.get_piece_size()) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if i not in special}
        chars = sorted({c for p in ids if len(p) > 1 for c in p})
        known = len(ids)
        self.char = {c: ids.get(c, (1 << 19) + n) for n, c in enumerate(chars)}
        self.weight = {(1 << 19) + n: len(c.encode()) for n, c in enumerate(chars) if c not in ids}
        self.single = {c for c in ids if len(c) == 1}
        symbols = self.char | ids
        scores = sorted({sp.get_score(i) for i in ids.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank[sp.get_score(i)], i)
        self.merger = Merger(pairs, max(map(len, ids)))
        self.neighbours = {p[k : k + 2] for p in ids for k in range(len(p) - 1)}
        if known != len(ids) or any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("pieces with a word mark inside aren't handled")
        inner = "".join(map(re.escape, (c for c in chars if c != MARK)))
        self.cut = re.compile(f"{MARK}*[{inner}]+|{MARK}+|[^{inner}{MARK}]+")
        self.seen: dict[str, int] = {}
        self.held = 0

    def _parts(self, word: str) -> list[str]:
        if len(word) < CUT_FROM:
            return [word]
        ends = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.neighbours]
        return [word[a:b] for a, b in zip([0, *ends], [*ends, len(word)])]

    def _learn(self, words: set[str]) -> None:
        owner, seqs = [], []
        for w in words:
            self.held += len(w)
            if w[0] in self.char:
                parts = self._parts(w)
                owner += [w] * len(parts)
                seqs += [[self.char[c] for c in x] for x in parts]
                self.seen[w] = 0
            else:
                self.seen[w] = sum(1 if c in self.single else len(c.encode()) for c in w)
        for w, left in zip(owner, self.merger.run(seqs)):
            self.seen[w] += len(left) + sum(self.weight.get(x, 1) - 1 for x in left[left >= 1 << 19].tolist())

    def counts(self, texts: list[str | None]) -> list[int]:
        out = []
        for k in range(0, len(texts), 256):
            cut = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts[k : k + 256]]
            if self.held > REMEMBERED:
                self.seen.clear()
                self.held = 0
            new: set[str] = set()
            for words in cut:
                new.update(words)
            self._learn(new.difference(self.seen))
            out += [sum(map(self.seen.__getitem__, words)) for words in cut]
        return out


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of docs' text; `model` is read where the tasks run."""
    key = ("pieces", model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = common.only_model(key, lambda: PieceCounter(model))
        for b in batches:
            n = counter.counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), "text")
    return common.in_batches(rows, count, "doc_id long, n_bytes long, n_tokens long", key)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether it has more than 4096."""
    docs = common.table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > 4096)
