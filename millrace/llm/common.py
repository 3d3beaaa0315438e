"""What several operators share: checkpoints, table reads, word splitting, hashing in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: the characters that separate words, `[\x20\x09-\x0D]`.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine only where none is set and Spark runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or os.path.join(tempfile.gettempdir(), "millrace-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder, so that lost executors cost nothing before here."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of Parquet files in the shared folder, read again. For rows with whole texts."""
    path = f"{_shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Bytes of an Arrow batch of texts: a worker holds a batch several times over, as arrays, strings and results.
BATCH_BYTES = 1 << 20


def in_batches(df: DataFrame, f: Callable, schema: str, model: tuple | None = None) -> DataFrame:
    """df.mapInArrow; from here on the session's batches are of BATCH_BYTES at most (and one row at least).

    model: the key of the model that f asks `only_model` for; what a worker kept of others goes before f begins.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not (conf.get(key).rstrip("b").isdigit() and 0 < int(conf.get(key).rstrip("b")) <= BATCH_BYTES):
        conf.set(key, f"{BATCH_BYTES}b")

    def run(batches):
        forget_models_but(model)
        _give_back()
        yield from f(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Memory that earlier tasks freed in this worker goes back to the system, where the C library can do that."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


_MODEL: dict = {}


def forget_models_but(key: tuple | None) -> None:
    for other in _MODEL.keys() - {key}:
        del _MODEL[other]


def only_model(key: tuple, make: Callable):
    """make(), which this Python worker keeps until it is asked for another one: workers are used again by later jobs."""
    forget_models_but(key)
    if key not in _MODEL:
        _MODEL[key] = make()
    return _MODEL[key]


def has_rows_within(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows: the size check before a broadcast."""
    return df.limit(most + 1).count() <= most


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name with so many underscores before it that df has no such column, in upper or lower case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}".lower() in taken:
            name = f"_{name}"
        out.append(f"_{name}")
    return out


def n_words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(text.isNull() | (trimmed == ""), F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RE))).cast("long")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod modulus = remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


M64 = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_POW: list[np.ndarray] = []
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2^64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for b in (_BASE, inverse):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                p = np.multiply.accumulate(p)
                _POW.append(p)
        del _POW[:-2]
    return _POW[-2], _POW[-1]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Bytes between words of letters: all of ASCII but letters.
NOT_LETTER = np.arange(256) < 128
NOT_LETTER[65:91] = NOT_LETTER[97:123] = False


def word_hashes(text: str | None, between: np.ndarray = _IS_SPACE, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """One unsigned 64-bit hash per word, in order; A-Z count as a-z.

    between: the bytes that separate words. prefixes: for each, hashes of the first so many bytes of the longer words follow.
    """
    b = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    if not len(b):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(b) + 2, bool)
    np.logical_not(between[b], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
        out = [mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * M64)]
        for k in prefixes:
            at = starts[ends - starts > k]
            out.append(mix64((total[at + k] - total[at]) * inverse[at] + np.uint64(k << 32)))
    return np.concatenate(out) if prefixes else out[0]


def shingle_hashes(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of all k-word shingles; of the whole sequence where there are fewer words."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(k, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, np.uint64(n), np.uint64)
        for i in range(n):
            h *= M64
            h += w[i : len(w) - n + 1 + i]
    return np.unique(mix64(h))
