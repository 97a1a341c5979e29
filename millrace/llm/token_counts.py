"""Token counts by the whole-token shortcut.

Before any text is read, every vocabulary string that can stand alone is encoded
once, and those that come back as the one token they name are kept: a pre-token
equal to such a string counts as one without merging. Only the other pre-tokens
are merged, and each process remembers the counts of those it has met.

Chunks of letters up to U+024F are lowered and cut here; those with others, and
texts with the four ASCII separators, by the library's own normalizer and
pre-tokenizer, whose Unicode tables are the ones that count. Their pre-tokens
are then counted in the same two ways. Only chunks that hold the string of a
special token are encoded by the library.

Null and empty texts have 0 bytes and 0 tokens. Very long texts are counted
whole, one at a time. Rows are kept as they come, repeated ones and null ids
too. An empty table gives no rows. Columns that the input has besides are
dropped, whatever they are called.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merging import Remembered, merge
from .tokens import SEPARATORS, byte_characters, settled

WORD_END = "</w>"


@functools.cache
def prove_whole_tokens(path: str) -> tuple[str, ...]:
    """Strings of the vocabulary that, alone, encode as exactly their own token."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    byte_of = {c: b for b, c in byte_characters().items()}
    names: list[tuple[str, int]] = []
    for name, token in library.get_vocab(with_added_tokens=False).items():
        if name.endswith(WORD_END) and all(c in byte_of for c in name[: -len(WORD_END)]):
            try:
                text = bytes(byte_of[c] for c in name[: -len(WORD_END)]).decode()
            except UnicodeDecodeError:
                continue
            if text:
                names.append((text, token))
    encoded = library.encode_batch([text for text, _ in names], add_special_tokens=False)
    return tuple(text for (text, token), e in zip(names, encoded) if e.ids == [token])


class MergedCounts(Remembered):
    """Tokens of pre-tokens that aren't proven whole, by pair merging."""

    def __init__(self, merges: list):
        super().__init__()
        self.ranks = {pair if isinstance(pair, str) else " ".join(pair): i for i, pair in enumerate(merges)}
        self.characters = byte_characters()

    def work(self, piece: str) -> int:
        parts = [self.characters[b] for b in piece.encode()]
        parts[-1] += WORD_END
        return len(merge(parts, self.ranks, " "))


class MergedNames(MergedCounts):
    """The same of pre-tokens in the printable characters that stand for their bytes."""

    def work(self, piece: str) -> int:
        parts = list(piece)
        parts[-1] += WORD_END
        return len(merge(parts, self.ranks, " "))


class TokenCounter(Remembered):
    """From a white-space-separated chunk to its number of tokens."""

    def __init__(self, path: str, whole: tuple[str, ...]):
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.whole = frozenset(whole)
        self.merged = MergedCounts(spec["model"]["merges"])
        self.named = MergedNames(spec["model"]["merges"])
        characters = byte_characters()
        self.whole_names = frozenset("".join([characters[b] for b in w.encode()]) for w in whole)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pre_tokens = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def work(self, chunk: str) -> int:
        if any(s in chunk for s in self.special):
            return len(self.library.encode(chunk, add_special_tokens=False).ids)
        if not settled(chunk):
            return self.cut_by_library(chunk)
        if chunk.isascii():
            plain = chunk.lower()
            if plain in self.whole:
                return 1
            if plain.isalpha():
                return self.merged[plain]
        else:
            plain = "".join([c.lower() for c in unicodedata.normalize("NFC", chunk)])
        return sum([1 if p in self.whole else self.merged[p] for p in self.pre_tokens.findall(plain)])

    def cut_by_library(self, text: str) -> int:
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return sum([1 if name in self.whole_names else self.named[name] for name, _ in pieces])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if SEPARATORS.search(text):
            return self.work(text) if any(s in text for s in self.special) else self.cut_by_library(text)
        return sum(map(self.__getitem__, text.split()))


_counters: dict[str, TokenCounter] = {}


def token_counts(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    The proven strings are broadcast; there are at most as many as the vocabulary has.
    """
    spark = df.sparkSession
    whole = spark.sparkContext.broadcast(prove_whole_tokens(path))

    def run(batches):
        counter = _counters.get(path)
        if counter is None:
            counter = _counters[path] = TokenCounter(path, whole.value)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
