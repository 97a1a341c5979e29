"""Ids of whole texts by a tokenizers file whose pre-tokens never span white space.

The vocabulary drops white space before it merges, so the ids of a text are the
ids of its white-space-separated chunks in a row. Each process keeps the ids of
chunks that it has met, as little-endian 32-bit bytes, in a bounded cache; of
others the library's model merges the pre-tokens, or the library encodes them
where they hold what normalisation may change. Characters that Python's ``split`` takes for white
space and the library doesn't (the four ASCII separators) send the whole text
to the library.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import regex

from .merging import Remembered

SEPARATORS = re.compile("[\x1c-\x1f]")
#: Marks that end a pre-token of letters and are one themselves.
MARKS = frozenset(".,!?;:")
#: The vocabulary's pre-tokens, and what its special tokens begin with.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPECIAL = "<|"

#: Up to here lower-casing (but for one letter) and composition change no letter in a way that depends on the Unicode version.
SETTLED = "\u024f"
UNSETTLED = "\u0130"


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_NAMES = byte_characters()


def settled(chunk: str) -> bool:
    return chunk.isascii() or (max(chunk) <= SETTLED and UNSETTLED not in chunk)


_encoders: dict[str, ChunkEncoder] = {}


class ChunkEncoder(Remembered):
    """From a chunk to its ids' bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size(with_added_tokens=True))]

    def modelled(self, names: str) -> bytes:
        """Ids of one pre-token that the normalizer would leave as it is, by the library's model alone."""
        as_bytes = self.id_bytes
        return b"".join([as_bytes[t.id] for t in self.model.tokenize(names)])

    def direct(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def work(self, chunk: str) -> bytes:
        if chunk.isalpha() and chunk.isascii() and chunk.islower():
            return self.modelled(chunk)
        if not settled(chunk) or SPECIAL in chunk:
            return self.direct(chunk)
        mark = chunk[-1]
        if mark in MARKS and chunk[:-1].isalpha():
            return self[chunk[:-1]] + self[mark]
        lower = chunk.lower()
        if lower != chunk:
            return self[lower]
        pieces = PRE_TOKENS.findall(chunk)
        if len(pieces) == 1:
            return self.modelled(chunk.encode().decode("latin-1").translate(BYTE_NAMES))
        return b"".join([self[p] for p in pieces])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SEPARATORS.search(text):
            return self.direct(text)
        return b"".join(map(self.__getitem__, text.split()))


def chunk_encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def encode_column(texts: pa.Array, path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the offsets where each text begins (one more than texts)."""
    encode = chunk_encoder(path).encode
    end = b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()
    parts = [encode(text) + end for text in texts.to_pylist()]
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), dtype="<u4"), offsets


def id_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def crc32_of(ids: np.ndarray, starts, ends) -> list[int]:
    view = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    return [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts, ends)]
