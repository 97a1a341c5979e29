"""Byte-level functions of records: entropy, histograms, JSON validity, sizes. Records are bytes; strings count as their UTF-8."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers of byte-size literals.
SIZE_UNITS = {"": 1, "b": 1, "k": 10**3, "kb": 10**3, "m": 10**6, "mb": 10**6, "g": 10**9, "gb": 10**9, "t": 10**12, "tb": 10**12,
              "ki": 2**10, "kib": 2**10, "mi": 2**20, "mib": 2**20, "gi": 2**30, "gib": 2**30, "ti": 2**40, "tib": 2**40}
MOST_JSON_DEPTH = 128


def parse_size(text: str) -> int:
    """Bytes of a literal such as ``16MiB``, ``1.5k`` or ``200``."""
    found = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*([a-zA-Z]*)\s*", text)
    if not found or found[2].lower() not in SIZE_UNITS:
        raise ValueError(f"not a byte size: {text!r}")
    return int(float(found[1]) * SIZE_UNITS[found[2].lower()]) if "." in found[1] else int(found[1]) * SIZE_UNITS[found[2].lower()]


def humanize(n: float) -> str:
    """Bytes with a binary unit."""
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if n < 1024 or unit == "TiB":
            return f"{n:.0f} B" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    raise AssertionError


def entropy_of(raw: bytes) -> float:
    if not raw:
        return 0.0
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    p = counts[counts > 0] / len(raw)
    return float(-(p * np.log(p)).sum())


def _entropies(records: pd.Series) -> pd.Series:
    return records.map(lambda r: entropy_of((r or b"") + b"\n")).astype(float)


def as_bytes(record: Column | str) -> Column:
    return (F.col(record) if isinstance(record, str) else record).cast("binary")


def byte_entropy(record: Column | str) -> Column:
    """Shannon entropy in nats of each record with its line end; null counts as the line end alone."""
    return F.pandas_udf(_entropies, "double")(as_bytes(record))


SPACE = re.compile(rb"[ \t\n\r]*")
STRING = re.compile(rb'"(?:[^"\\\x00-\x1f]++|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+')
STRINGS = re.compile(rb'"(?:[^"\\]++|\\.)*+"', re.DOTALL)
HEX = re.compile(rb"[0-9a-fA-F]{0,4}")
NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
LITERALS = {b"t": b"true", b"f": b"false", b"n": b"null"}
OPEN, CLOSE = b"{[", {b"{": b"}", b"[": b"]"}


class _Problem(Exception):
    """kind and byte position."""


def _no_constant(name: str):
    raise ValueError(name)


def _string_end(raw: bytes, at: int) -> int:
    if raw[at : at + 1] != b'"':
        raise _Problem("bad_string", at)
    e = STRING.match(raw, at).end()
    if e == len(raw) or (raw[e : e + 1] == b"\\" and e + 1 == len(raw)):
        raise _Problem("unexpected_eof", len(raw))
    if raw[e : e + 1] == b'"':
        return e + 1
    if raw[e : e + 1] != b"\\":
        raise _Problem("bad_string", e)
    if raw[e + 1 : e + 2] != b"u":
        raise _Problem("bad_string", e + 1)
    wrong = HEX.match(raw, e + 2).end()
    raise _Problem(*(("unexpected_eof", len(raw)) if wrong == len(raw) else ("bad_unicode", wrong)))


def _scalar_end(raw: bytes, at: int) -> int:
    c = raw[at : at + 1]
    if c == b'"':
        return _string_end(raw, at)
    if c in LITERALS:
        if not raw.startswith(LITERALS[c], at):
            raise _Problem("bad_literal", at)
        return at + len(LITERALS[c])
    if c not in b"-0123456789":
        raise _Problem("unexpected", at)
    number = NUMBER.match(raw, at)
    if not number:
        raise _Problem("bad_number", at)
    e = number.end()
    more = raw[e : e + 1]
    if number[2] is None and (more in (b"e", b"E") or (more == b"." and number[1] is None)):
        raise _Problem("bad_number", at)
    return e


def _walk(raw: bytes, limit: int) -> None:
    """Raises the first problem of a text, value by value, with the open brackets on a stack."""
    skip = lambda at: SPACE.match(raw, at).end()

    def key(at: int) -> int:
        at = skip(_string_end(raw, skip(at)))
        if raw[at : at + 1] != b":":
            raise _Problem("unexpected" if at < len(raw) else "unexpected_eof", at)
        return at + 1

    opened: list[bytes] = []
    at = 0
    while True:
        at = skip(at)
        c = raw[at : at + 1]
        if not c:
            raise _Problem("unexpected_eof", at)
        if c in OPEN:
            if len(opened) >= limit:
                raise _Problem("too_deep", at)
            inner = skip(at + 1)
            if raw[inner : inner + 1] != CLOSE[c]:
                opened.append(c)
                at = key(inner) if c == b"{" else inner
                continue
            at = inner + 1
        else:
            at = _scalar_end(raw, at)
        while True:  # behind a value
            at = skip(at)
            c = raw[at : at + 1]
            if not opened:
                if c:
                    raise _Problem("trailing", at)
                return
            if not c:
                raise _Problem("unexpected_eof", at)
            if c == b",":
                at = key(at + 1) if opened[-1] == b"{" else at + 1
                break
            if c != CLOSE[opened.pop()]:
                raise _Problem("unexpected", at)
            at += 1


def json_problem_of(raw: bytes | None, limit: int = MOST_JSON_DEPTH) -> tuple[str, int] | None:
    """What first keeps bytes from being one JSON value nested at most ``limit`` deep, and at which byte; None if nothing does.

    Kinds: unexpected_eof, unexpected, too_deep, trailing, bad_string, bad_unicode, bad_number, bad_literal. Bytes
    beyond ASCII may stand in strings whatever they are. Nearly all records pass a fast parser; only the others are
    walked through.
    """
    raw = raw or b""
    try:
        if raw.count(b"[") + raw.count(b"{") <= limit:
            json.loads(raw.decode("latin-1"), parse_constant=_no_constant, parse_int=str, parse_float=str)
            return None
    except ValueError:
        pass
    try:
        _walk(raw, limit)
    except _Problem as e:
        return e.args
    return None


def json_error(text: str | bytes | None) -> str | None:
    """``json_problem_of`` in words."""
    found = json_problem_of(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text)
    return found and f"{found[0].replace('_', ' ')} at byte {found[1]}"


def _valid(records: pd.Series) -> pd.Series:
    return records.map(lambda r: json_problem_of(r) is None).astype(bool)


def _problems(records: pd.Series) -> pd.DataFrame:
    found = [json_problem_of(r) or (None, None) for r in records]
    return pd.DataFrame({"kind": [k for k, _ in found], "at": pd.array([a for _, a in found], dtype="Int64")})


def json_valid(record: Column | str) -> Column:
    return F.pandas_udf(_valid, "boolean")(as_bytes(record))


def json_problem(record: Column | str) -> Column:
    """kind and at (byte) of what keeps a record from being valid JSON; both null if it is."""
    return F.pandas_udf(_problems, "kind string, at long")(as_bytes(record))
