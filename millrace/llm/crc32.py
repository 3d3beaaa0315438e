"""CRC-32 of words and of runs of words, in numpy: each word's is computed once, runs are composed.

Appending zero bytes to a message is linear over GF(2) in its CRC, so a matrix per power of two moves
a CRC past any number of bytes, and crc(a + b) = moved(crc(a), len(b)) ^ crc(b): no run of words is
ever put together as a string.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The polynomial of CRC-32 in zlib and gzip, bits reversed.
POLYNOMIAL = 0xEDB88320
#: Words up to so many bytes are computed together, byte by byte along the words; longer ones each at once.
TOGETHER = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.arange(256) >= 128
_IN_WORD[48:58] = _IN_WORD[97:123] = True


def _step_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


STEP = _step_table()


def _times(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """matrix: what it makes of each value of each of the four bytes."""
    return matrix[0][crc & 255] ^ matrix[1][crc >> 8 & 255] ^ matrix[2][crc >> 16 & 255] ^ matrix[3][crc >> 24]


def _shift_matrices() -> list[np.ndarray]:
    """For 1, 2, 4, ... 2^39 zero bytes."""
    values = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    out = [STEP[values & 255] ^ (values >> 8)]
    for _ in range(39):
        out.append(_times(out[-1], out[-1]))
    return out


SHIFTS = _shift_matrices()


def moved(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The CRCs' share once so many bytes follow."""
    crc = crc.astype(np.uint32, copy=True)
    for bit in range(int(n_bytes.max(initial=0)).bit_length()):
        at = np.flatnonzero(n_bytes >> bit & 1)
        crc[at] = _times(SHIFTS[bit], crc[at])
    return crc


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and ends; nulls are empty."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC, length in bytes and index of the text of every word `[0-9a-z\\x80-\\xff]+`; A-Z count as a-z."""
    raw, at = _bytes_of(texts)
    b = _LOWER[raw]
    inside = np.zeros(len(b) + 1, bool)
    inside[:-1] = _IN_WORD[b]
    first = np.zeros(len(b) + 1, bool)
    first[at] = True
    starts = np.flatnonzero(inside[:-1] & (first[:-1] | ~np.concatenate([[False], inside[:-2]]))) if len(b) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside[:-1] & (first[1:] | ~inside[1:])) + 1
    length = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(length, TOGETHER + 1), kind="stable")
    n_long = int((length > TOGETHER).sum())
    for w in order[:n_long].tolist():
        crc[w] = zlib.crc32(b[starts[w] : ends[w]])
    order = order[n_long:]
    begin, now = starts[order], crc[order]
    n = np.searchsorted(-length[order], -np.arange(TOGETHER))  # words longer than 0, 1, ... bytes
    for k in range(TOGETHER):
        if not n[k]:
            break
        c = now[: n[k]]
        now[: n[k]] = STEP[(c ^ b[begin[: n[k]] + k]) & 255] ^ (c >> 8)
    crc[order] = ~now
    return crc, length, np.searchsorted(at, starts, side="right") - 1


def runs(crc: np.ndarray, length: np.ndarray, text: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... `most` words joined by one space: the CRC of every run within a text, and the text's index."""
    yield crc, text
    if most < 2:
        return
    spaced = moved(np.full(len(crc), zlib.crc32(b" "), np.uint32), length) ^ crc
    now = crc
    for n in range(2, most + 1):
        if len(now) < 2:
            return
        now = moved(now[:-1], length[n - 1 :] + 1) ^ spaced[n - 1 :]
        same = text[: len(now)] == text[n - 1 :]
        yield now[same], text[: len(now)][same]
