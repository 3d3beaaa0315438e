"""The value that a script of a page assigns to a name, as JSON text: read by balance of brackets, never run."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s+|//[^\n]*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|[{}\[\],:]|!\s*[01]|[-+]?[\w.$]+""", re.S)
_WORDS = {"undefined": "null", "NaN": "null", "!0": "true", "!1": "false"}
_NUMBER = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


def _string(token: str) -> str:
    value = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "ux" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), token[1:-1])
    return json.dumps(value, ensure_ascii=False)


def literal(text: str, at: int) -> str | None:
    """The object or array that begins at a place, as JSON; None if it isn't one, or doesn't end."""
    out: list[str] = []
    depth = 0
    while m := _TOKEN.match(text, at):
        at, token = m.end(), m[0]
        if token.isspace() or token.startswith(("//", "/*")):
            continue
        if token[0] in "\"'`":
            out.append(_string(token))
        elif token in "}]":
            if out and out[-1] == ",":
                out.pop()
            out.append(token)
            depth -= 1
        elif token in "{[":
            out.append(token)
            depth += 1
        elif token in ",:":
            out.append(token)
        else:
            word = _WORDS.get(re.sub(r"\s", "", token), token)
            out.append(word if word in ("true", "false", "null") or _NUMBER.fullmatch(word) else json.dumps(word))
        if depth == 0:
            return "".join(out) if token in "}]" else None
    return None


def assigned(html: str | None, name: str) -> str | None:
    """The first object or array assigned to the name."""
    for m in re.finditer(rf"(?<![\w$.]){re.escape(name)}\s*=(?!=)\s*", html or ""):
        if found := literal(html, m.end()):
            return found
    return None


def from_name(html: Column, name: str) -> Column:
    """The page from the first mention of the name on, and the character before it; null without one."""
    at = F.locate(name, html)
    return F.when(at > 0, F.substring(html, F.greatest(at - 1, F.lit(1)), F.length(html)))


def assigned_json(html: Column, name: str) -> Column:
    @F.arrow_udf("string")
    def read(pages: pa.Array) -> pa.Array:
        return pa.array((assigned(p.as_py(), name) for p in pages), pa.string())

    return read(from_name(html, name))
