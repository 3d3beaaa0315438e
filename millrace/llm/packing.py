"""Best-fit packing of token sequences with certified bin counts.

Documents are tokenized once, next to their rows; from then on only piece lengths move. Pieces as
long as a sequence fill one each. The others are dealt into partitions of bounded size and packed
by best-fit decreasing. A lower bound from dual feasible functions certifies a partition whose bin
count can't be lowered. Partitions with a gap keep the bins that are full enough and hand the
pieces of the rest to an exchange, which deals them out anew (other partitions' leftovers make
better fits) and packs again, until a round saves nothing or `rounds` are over.

Defined results: a null or empty text is the single id 0; rows with the same id, or a null one, are
packed each, and ids of any size stay as they are; pieces of equal length are dealt by hash and
packed by id and piece; a text of any length is tokenized whole and cut only into pieces of `capacity`;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .merging import LONG, Merger

#: Pieces packed by one task at a time.
PER_PARTITION = 40_000
#: Characters of distinct words that a Python worker remembers; then it starts afresh.
REMEMBERED = 4_000_000

# Texts of these characters alone are cut here, by the same pattern as the tokenizer's; any other text goes to the tokenizer whole.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]|<\\|")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\r0-9a-zß-öø-ÿ]+").findall
_LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch


class _Places(dict):
    """Words by the order in which they were first asked for; `fresh` are those since it was last emptied."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.fresh.append(word)
        return place


class WordEncoder:
    """Ids of the word-end BPE tokenizer at `path` as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        self.merger = Merger(pairs, max(map(len, vocab)))
        # The byte alphabet: printable bytes stand for themselves, the rest for U+0100 and on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        sign = [chr(b) if b in shown else chr(next(other)) for b in range(256)]
        self.inner, self.last = np.array([vocab[c] for c in sign], np.int64), np.array([vocab[c + end] for c in sign], np.int64)
        self._forget()

    def _forget(self) -> None:
        """Words that are remembered: where their ids begin in `ids`, and how many they are."""
        self.places, self.held = _Places(), 0
        self.ids, self.begin, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n_ids = self.n_words = 0

    def _learn(self, words: list[str]) -> None:
        """The ids of words, after those known so far."""
        spelled = np.fromiter((bool(_LETTERS(w)) and len(w) <= LONG // 2 for w in words), bool, len(words))
        raw = [w.encode() for w, s in zip(words, spelled.tolist()) if s]
        b = np.frombuffer(b"".join(raw), np.uint8)
        sym, lens = self.inner[b], np.fromiter(map(len, raw), np.int64, len(raw))
        last = np.cumsum(lens) - 1
        sym[last] = self.last[b[last]]
        merged, left = self.merger.run_flat(sym, lens)
        other = np.flatnonzero(~spelled).tolist()
        others = [e.ids for e in self.library.encode_batch([words[i] for i in other], add_special_tokens=False)]
        count = np.zeros(len(words), np.int64)
        count[spelled], count[other] = left, [len(x) for x in others]
        begin = self.n_ids + np.cumsum(count) - count
        self.n_ids, self.n_words = self.n_ids + int(count.sum()), self.n_words + len(words)
        self.ids, self.begin, self.count = _room(self.ids, self.n_ids), _room(self.begin, self.n_words), _room(self.count, self.n_words)
        self.ids[_runs(begin[spelled], left)] = merged
        for i, x in zip(other, others):
            self.ids[begin[i] : begin[i] + len(x)] = x
        self.begin[self.n_words - len(words) : self.n_words], self.count[self.n_words - len(words) : self.n_words] = begin, count

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(texts), 256):
            part = [t or "" for t in texts[k : k + 256]]
            if self.held > REMEMBERED:
                self._forget()
            cut = [None if _OTHER.search(t) else _WORDS(t.lower()) for t in part]
            n_words = np.array([len(w or ()) for w in cut])
            at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(w for w in cut if w)), np.int64, n_words.sum())
            if self.places.fresh:
                self.held += sum(map(len, self.places.fresh))
                self._learn(self.places.fresh)
                self.places.fresh = []
            count = self.count[at]
            whole = self.ids[_runs(self.begin[at], count)].astype("<u4").tobytes()
            ends = 4 * np.append(0, np.cumsum(count))[np.cumsum(n_words)]
            for t, words, a, z in zip(part, cut, np.append(0, ends).tolist(), ends.tolist()):
                out.append(whole[a:z] if words is not None else np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
        return out


def _runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(begin - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and a closing 0, cut where longer than capacity."""

    model = ("words", tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.only_model(model, lambda: WordEncoder(tokenizer))
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text").to_pylist())):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    def nonempty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut(b for b in batches if b.num_rows)

    return common.in_batches(docs.select(F.col("doc_id").cast("long"), "text"), nonempty, "doc_id long, piece int, start long, length long, ids_crc32 long", model)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset of each piece; what is used of each bin). A bit per remaining room finds the best fit."""
    order = np.argsort(-lengths, kind="stable")
    bins, offset, room = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            k = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
        else:
            r, k = capacity, len(room)
            room.append(capacity)
        bins[i], offset[i] = k, capacity - r
        room[k] = left = r - n
        if left:
            if not by_room[left]:
                mask |= 1 << left
            by_room[left].append(k)
    return bins, offset, capacity - np.array(room, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the area bound and two families of dual feasible functions, over all their thresholds."""
    if not len(lengths):
        return 0
    best = -(-int(lengths.sum()) // capacity)
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    for k in range(1, 21):  # u(k): x(k+1)/C if whole, else floor(x(k+1)/C) + ... scaled to k
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    many, area = np.cumsum(counts), np.cumsum(counts * size)
    total, full = many[-1], area[-1]
    t = np.arange(1, capacity // 2 + 1)  # pieces over C - t count as whole bins, those under t as nothing
    whole = total - many[capacity - t]
    middle = area[capacity - t] - area[t - 1]
    return max(best, int((whole + -(-middle // capacity)).max()))


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_STATE = f"{_PIECE}, sequence_id long, offset long, settled boolean"


def _pack(capacity: int, first: int):
    """Packs one dealt group; earlier bins, which come whole, stay where no bin is saved."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]).combine_chunks()
        lengths = rows["length"].to_numpy()
        least, had = lower_bound(lengths, capacity), rows["sequence_id"].null_count == 0
        sequence = rows["sequence_id"].to_numpy() if had else np.zeros(len(lengths), np.int64)
        offset = rows["offset"].to_numpy()
        count = len(np.unique(sequence)) if had else len(lengths) + 1
        if count > least:
            bins, places, used = best_fit_decreasing(lengths, capacity)
            if len(used) < count:
                sequence, offset, count = first + (key[0].as_py() << 24) + bins, places, len(used)
        _, own = np.unique(sequence, return_inverse=True)
        used = np.bincount(own, weights=lengths)[own]
        new = {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()), "settled": pa.array((used == capacity) | (count <= least))}
        return pa.table({n: new.get(n, rows[n]) for n in (x.split()[0] for x in _STATE.split(", "))})

    return pack


def packed(parts: DataFrame, capacity: int = 2048, rounds: int = 3, per_partition: int = PER_PARTITION) -> DataFrame:
    """Adds sequence_id and offset. `parts` is read several times: give a table or a checkpoint."""
    names = [x.split()[0] for x in _PIECE.split(", ")]
    zero = F.lit(0).cast("long")
    whole = parts.where(F.col("length") == capacity)
    done = [whole.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), zero.alias("offset"))]
    left = parts.where(F.col("length") < capacity).select(*names, F.lit(None).cast("long").alias("sequence_id"), zero.alias("offset"), F.lit(False).alias("settled"))
    before = None
    for k in range(rounds):
        n = left.count()
        if n == 0 or (before is not None and before <= per_partition):
            break
        groups, before = max(1, -(-n // per_partition)), n
        deal = F.xxhash64(F.lit(k), F.monotonically_increasing_id() if k == 0 else F.col("sequence_id"))
        got = common.cut(
            left.withColumn("_group", F.pmod(deal, F.lit(groups))).groupBy("_group").applyInArrow(_pack(capacity, k << 52), _STATE)
        )
        done.append(got.where("settled").drop("settled"))
        left = got.where("not settled")
    done.append(left.drop("settled"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    docs = common.table(spark, sf_dir, "documents")
    return packed(common.cut(pieces(docs, public_tokenizers.path("word_bpe_49k.json"))))
