import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import crc32

texts = st.lists(st.none() | st.text(alphabet="aZ09 .é語-\n_", max_size=40) | st.sampled_from(["x" * 47, "y" * 48 + " z", "w" * 49, "v" * 5000]), max_size=8)


def brute(values, most):
    out = []
    for n in range(1, most + 1):
        for i, t in enumerate(values):
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
            out += [(n, i, zlib.crc32(" ".join(w[k : k + n]).encode())) for k in range(len(w) - n + 1)]
    return out


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 4), st.integers(0, 3))
def test_runs_of_words(values, most, skipped):
    column = pa.array(values, pa.string())[skipped:]  # a slice has an offset
    got = [(n, int(i), int(c)) for n, (crc, text) in enumerate(crc32.runs(*crc32.words(column), most), 1) for c, i in zip(crc, text)]
    assert got == brute(values[skipped:], most)


def test_moved():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 255, 65_537, 3_000_001):
        a, b = rng.bytes(9), rng.bytes(n)
        crc = crc32.moved(np.array([zlib.crc32(a)], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(b))
        assert int(crc[0]) == zlib.crc32(a + b)
