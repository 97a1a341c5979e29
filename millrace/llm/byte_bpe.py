"""Byte-level BPE of whole texts without a regular expression.

A text becomes an array of code-point classes; a small automaton, which knows
the pre-tokenisation rules (runs of letters, of digits, of other marks, each
with one space before it; contractions; white space), reads the classes. Its
transition functions form a finite monoid under composition, so the states at
all positions come from an associative scan: one look-up table composes two
functions, all blocks of a text are scanned side by side, then the blocks'
totals. The slices between token starts feed pair merging, whose results each
process remembers in a bounded cache.

Each id keeps the byte of the text where its token begins; decoding writes every
token's bytes at that place.

Null texts are empty ones: no ids and the one offset 0. Repeated rows, null ids
and rows with equal ids are encoded one by one and kept. Very long texts are
scanned in segments that end where a token surely ends. An empty table gives no
rows. Columns besides those named are dropped, whatever they are called.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices
from .merging import Remembered, merge

SEGMENT = 1 << 20
BLOCK = 64

LETTER, DIGIT, OTHER, SPACE_IN_RUN, SPACE_LAST, BLANK_LAST, SHORT, LONG, END = range(9)
START, IN_LETTERS, IN_DIGITS, IN_OTHER, IN_SPACE, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)

#: White space of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at the symbol."""
    if symbol == END:
        return START, True
    if state in (ONE_MORE, TWO_MORE):
        if symbol == LETTER:  # of a contraction
            return (START if state == ONE_MORE else ONE_MORE), False
        state = START  # never reached: the symbols SHORT and LONG are given only where the letters follow
    if symbol in (SHORT, LONG):
        if state in (IN_OTHER, AFTER_SPACE):  # an apostrophe inside a run of marks
            return IN_OTHER, False
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol == SPACE_IN_RUN:
        return IN_SPACE, state != IN_SPACE
    if symbol == SPACE_LAST:
        return AFTER_SPACE, True
    if symbol == BLANK_LAST:
        return START, True
    run = {LETTER: IN_LETTERS, DIGIT: IN_DIGITS, OTHER: IN_OTHER}[symbol]
    return run, state not in (run, AFTER_SPACE)


@functools.cache
def _tables():
    """Function of each symbol, composition of functions, state each leads to from each state, starts."""
    functions = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *functions]))}
    grown = list(known)
    while grown:
        fresh = []
        for f in grown:
            for g in functions:
                h = tuple(g[s] for s in f)
                if h not in known:
                    known[h] = len(known)
                    fresh.append(h)
        grown = fresh
    all_of = list(known)
    assert len(all_of) < 256
    compose = np.array([[known[tuple(g[s] for s in f)] for g in all_of] for f in all_of], dtype=np.uint8)
    leads = np.array(all_of, dtype=np.uint8)
    starts = np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)])
    return np.array([known[f] for f in functions], dtype=np.uint8), compose, leads, starts


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = DIGIT
    out[WHITE_SPACE] = SPACE_IN_RUN
    return out


def _scan(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Composition of each function with all before it; its length is a multiple of BLOCK, or below BLOCK."""
    n = len(functions)
    if n <= BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], functions[i]]
        return out
    grid = np.ascontiguousarray(functions.reshape(-1, BLOCK).T)
    for r in range(1, BLOCK):
        grid[r] = compose[grid[r - 1], grid[r]]
    totals = grid[-1]
    padded = np.zeros(-(-len(totals) // BLOCK) * BLOCK if len(totals) > BLOCK else len(totals), dtype=np.uint8)
    padded[: len(totals)] = totals
    before = np.zeros(len(totals), dtype=np.uint8)  # function 0 is the identity
    before[1:] = _scan(padded, compose)[: len(totals) - 1]
    return compose[before[None, :], grid].T.reshape(-1)


def token_starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions where tokens start in texts written in a row, each followed by one place listed in ``ends``."""
    of_symbol, compose, leads, starts = _tables()
    n = len(codes)
    kind = _classes()[codes]
    kind[ends] = END
    symbols = np.full(-(-(n + 2) // BLOCK) * BLOCK, END, dtype=np.uint8)
    symbols[:n] = kind
    following = symbols[1 : n + 1]
    white = kind == SPACE_IN_RUN
    last = white & (following != SPACE_IN_RUN) & (following != END)
    symbols[:n][last] = np.where(codes[last] == 0x20, SPACE_LAST, BLANK_LAST)
    marks = np.flatnonzero((codes == 0x27) & (kind == OTHER))
    if len(marks):
        near = np.zeros(n + 2, dtype=np.uint32)
        near[:n] = np.where(kind == END, 0, codes)
        one, two = near[marks + 1], near[marks + 2]
        for tail in CONTRACTIONS:
            if len(tail) == 1:
                symbols[marks[one == ord(tail)]] = SHORT
            else:
                symbols[marks[(one == ord(tail[0])) & (two == ord(tail[1]))]] = LONG
    done = _scan(of_symbol[symbols], compose)
    states = np.empty(n, dtype=np.uint8)
    states[:1] = START
    states[1:] = leads[done[: n - 1], START]
    return np.flatnonzero(starts[states, symbols[:n]])


def segments(text: str) -> list[str]:
    """``text`` in parts of about SEGMENT characters that end between a letter and a space before a letter."""
    if len(text) <= SEGMENT:
        return [text]
    out, at = [], 0
    while len(text) - at > SEGMENT:
        cut = at + SEGMENT
        while cut + 1 < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        if cut + 1 >= len(text):
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def slices(texts: list[str]) -> list[list[str]]:
    """Pre-tokens of each text."""
    if not texts:
        return []
    joined = "\0".join(texts) + "\0"
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths + 1) - 1
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = token_starts(codes, ends)
    first = np.searchsorted(starts, ends - lengths).tolist()
    stop = np.searchsorted(starts, ends).tolist()
    at = starts.tolist()
    pieces = [joined[a:b] for a, b in zip(at, at[1:])]
    return [pieces[a:b] for a, b in zip(first, stop)]


class ByteEncoder(Remembered):
    """From a pre-token to its ids' little-endian 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.words = [b""] * (max(self.ranks.values()) + 1)
        for word, token in self.ranks.items():
            self.words[token] = word
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.words), dtype=np.uint8)

    def work(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        token = self.ranks.get(raw)
        if token is not None:
            return token.to_bytes(4, "little")
        parts = merge([raw[i : i + 1] for i in range(len(raw))], self.ranks)
        return np.array([self.ranks[p] for p in parts], dtype="<u4").tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        parts: list[str] = []
        counts = []
        for text in texts:
            own = segments(text or "")
            parts += own
            counts.append(len(own))
        encoded: list[bytes] = []
        group: list[str] = []
        size = 0
        for part in parts:
            group.append(part)
            size += len(part) + 1
            if size >= SEGMENT:
                encoded += [b"".join(map(self.__getitem__, own)) for own in slices(group)]
                group, size = [], 0
        encoded += [b"".join(map(self.__getitem__, own)) for own in slices(group)]
        out, at = [], 0
        for n in counts:
            out.append(b"".join(encoded[at : at + n]))
            at += n
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte of the text where each token begins, and the text's length."""
        places = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(self.lengths[ids], out=places[1:])
        return places

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The text's bytes: those of each token, written from its offset on up to the next one's."""
        sizes = np.diff(offsets)
        if (sizes != self.lengths[ids]).any() or offsets[0] != 0:
            raise ValueError("ids and offsets of a document disagree")
        first = self.places[ids] - offsets[:-1]  # from a place in the text to one in the vocabulary
        return self.flat[np.repeat(first, sizes) + np.arange(offsets[-1])].tobytes()

    def digests(self, raw: bytes) -> tuple[int, str, str, str]:
        """Number of tokens, and SHA-256 of ids, of the bytes decoded from ids and offsets, and of the offsets."""
        ids = np.frombuffer(raw, dtype="<u4")
        offsets = self.offsets(ids)
        decoded = self.decode(ids, offsets)
        return len(ids), *(hashlib.sha256(x).hexdigest() for x in (raw, decoded, offsets.astype("<u8").tobytes()))


_encoders: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids array<int>, offsets array<long>: the byte of the text where each token begins, and its length."""

    def run(batches):
        encoder = byte_encoder(path)
        for batch in in_slices(batches):
            coded = encoder.encode_all(batch.column("text").to_pylist())
            counts = np.array([len(c) // 4 for c in coded], dtype=np.int64)
            bounds = np.zeros(len(coded) + 1, dtype=np.int64)
            np.cumsum(counts, out=bounds[1:])
            ids = np.frombuffer(b"".join(coded), dtype="<u4")
            run_ends = np.zeros(len(ids) + 1, dtype=np.int64)
            np.cumsum(encoder.lengths[ids], out=run_ends[1:])
            places = np.concatenate([run_ends[a : b + 1] - run_ends[a] for a, b in zip(bounds, bounds[1:])]) if len(coded) else run_ends[:0]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array((bounds + np.arange(len(bounds))).astype(np.int32)), pa.array(places)),
                ],
                names=["id", "ids", "offsets"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, offsets array<long>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``encode`` with their bytes, written by the offsets that were kept."""

    def run(batches):
        encoder = byte_encoder(path)
        for batch in batches:
            lists, kept = batch.column("ids"), batch.column("offsets")
            flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            places, place_bounds = kept.values.to_numpy(zero_copy_only=False), kept.offsets.to_numpy()
            decoded = [encoder.decode(flat[a:b], places[c:d]) for a, b, c, d in zip(bounds, bounds[1:], place_bounds, place_bounds[1:])]
            raw_ids = [flat[a:b].astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:])]
            counts = pa.array(np.diff(bounds).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), counts, pa.array(raw_ids, pa.binary()), pa.array(decoded, pa.binary())], names=["id", "n_tokens", "ids_bytes", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return (
        encoded.select(F.col(id_col).alias("id"), "ids", "offsets")
        .mapInArrow(run, f"id {kind}, n_tokens long, ids_bytes binary, decoded binary")
        .withColumnRenamed("id", id_col)
    )


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (of ids as little-endian 32-bit integers), decoded_sha256 and offsets_sha256
    (of offsets as little-endian 64-bit integers). A document is encoded, and decoded from its ids and offsets, in one task."""

    def run(batches):
        encoder = byte_encoder(path)
        for batch in in_slices(batches):
            found = [encoder.digests(raw) for raw in encoder.encode_all(batch.column("text").to_pylist())]
            counts, *digests = ([f[k] for f in found] for k in range(4))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), *(pa.array(d, pa.string()) for d in digests)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string").withColumnRenamed("id", id_col)
