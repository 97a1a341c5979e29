"""Licence wordings in texts, by templates compiled into one token automaton.

A template's words become states of a nondeterministic automaton over words; an
optional region may be skipped, a replaceable one takes some words of any kind or
one of several wordings. All templates run at once over a text's words, from any
place, as a deterministic automaton whose states are made when they are first
met; words that no template has are one letter of its alphabet. A template is
found where all its mandatory words stand, in order and with nothing else between
them than its regions allow. From the end of a find the automaton is followed
backwards to the nearest beginning. Phrases are templates of words alone.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are made small: digits,
letters and everything beyond ASCII. Texts are read whole; null and empty ones
have no words, and very long ones a bounded state besides their words. Rows are
judged one by one, so repeated rows and null ids come back as they are; an empty
table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices
from .license_templates import PHRASES, TEMPLATES

#: Digits, small letters and all bytes beyond ASCII stay, capitals in lower case; others part words.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MARKUP = re.compile(r'<<(beginOptional|endOptional|var;words="(\d+)\.\.(\d+)"|var;match="([^"]*)")>>')
#: States of the deterministic automaton that are kept; it is begun anew beyond.
MOST_STATES = 20_000
SURE, NAMED = 1.0, 0.5


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(TO_WORDS).split()


def parsed(template: str) -> list:
    """A template as a list of words (bytes), ("any", a, b), ("one", [words, ...]) and ("optional", list)."""
    stack: list[list] = [[]]
    at = 0
    for mark in MARKUP.finditer(template):
        stack[-1] += words_of(template[at : mark.start()].encode())
        at = mark.end()
        if mark[1] == "beginOptional":
            stack.append([])
        elif mark[1] == "endOptional":
            if len(stack) < 2:
                raise ValueError("an optional region ends that doesn't begin")
            region = stack.pop()
            if region:
                stack[-1].append(("optional", region))
        elif mark[2]:
            stack[-1].append(("any", int(mark[2]), int(mark[3])))
        else:
            stack[-1].append(("one", [words_of(x.encode()) for x in mark[4].split("|")]))
    stack[-1] += words_of(template[at:].encode())
    if len(stack) > 1:
        raise ValueError("an optional region doesn't end")
    if not stack[0] or isinstance(stack[0][0], tuple) and stack[0][0][0] != "one":
        raise ValueError("a template begins with its wording")
    return stack[0]


class Automaton:
    """Finds (template, start, end) of templates in lists of words."""

    def __init__(self, templates: list[str]):
        self.by_word: list[dict[bytes, set[int]]] = []
        self.by_any: list[set[int]] = []
        self.free: list[set[int]] = []
        self.ends: dict[int, int] = {}
        self.start = self._state()
        self.first: list[int] = []
        for k, template in enumerate(templates):
            first = self._state()
            self.free[self.start].add(first)
            self.first.append(first)
            self.ends[self._add(parsed(template), first)] = k
        self.alphabet = {w: w for edges in self.by_word for w in edges}
        self.back_word: list[dict[bytes, set[int]]] = [{} for _ in self.by_word]
        self.back_any: list[set[int]] = [set() for _ in self.by_word]
        self.back_free: list[set[int]] = [set() for _ in self.by_word]
        for a in range(len(self.by_word)):
            for w, to in self.by_word[a].items():
                for b in to:
                    self.back_word[b].setdefault(w, set()).add(a)
            for b in self.by_any[a]:
                self.back_any[b].add(a)
            for b in self.free[a]:
                self.back_free[b].add(a)
        self._begin()

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append(set())
        self.free.append(set())
        return len(self.free) - 1

    def _words(self, words: list[bytes], state: int) -> int:
        for w in words:
            after = self._state()
            self.by_word[state].setdefault(w, set()).add(after)
            state = after
        return state

    def _add(self, items: list, state: int) -> int:
        """States for ``items`` from ``state`` on; the last of them."""
        for item in items:
            if isinstance(item, bytes):
                state = self._words([item], state)
                continue
            after = self._state()
            if item[0] == "optional":
                self.free[state].add(after)
                self.free[self._add(item[1], state)].add(after)
            elif item[0] == "one":
                for words in item[1]:
                    self.free[self._words(words, state)].add(after)
            else:
                for n in range(item[2]):
                    if n >= item[1]:
                        self.free[state].add(after)
                    more = self._state()
                    self.by_any[state].add(more)
                    state = more
                self.free[state].add(after)
            state = after
        return state

    def _closed(self, states: set[int], free: list[set[int]]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in free[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return frozenset(out)

    def _begin(self) -> None:
        self.names: dict[frozenset[int], int] = {}
        self.members: list[frozenset[int]] = []
        self.table: list[dict] = []
        self.found: list[list[int]] = []
        self._name(self._closed({self.start}, self.free))

    def _name(self, states: frozenset[int]) -> int:
        if states not in self.names:
            self.names[states] = len(self.members)
            self.members.append(states)
            self.table.append({})
            self.found.append([self.ends[s] for s in states if s in self.ends])
        return self.names[states]

    def _step(self, state: int, word: bytes | None) -> int:
        after = {self.start}
        for s in self.members[state]:
            after |= self.by_any[s]
            if word is not None:
                after |= self.by_word[s].get(word, set())
        following = self._closed(after, self.free)
        if len(self.members) >= MOST_STATES and following not in self.names:
            self._begin()
            return self._name(following)
        self.table[state][word] = to = self._name(following)
        return to

    def _beginning(self, words: list[bytes], template: int, end: int) -> int:
        """The nearest place before ``end`` from which the template leads to it."""
        states = self._closed({s for s, k in self.ends.items() if k == template}, self.back_free)
        for i in range(end - 1, -1, -1):
            before: set[int] = set()
            for s in states:
                before |= self.back_any[s] | self.back_word[s].get(words[i], set())
            states = self._closed(before, self.back_free)
            if self.first[template] in states:
                return i
        raise AssertionError("a find has a beginning")

    def places(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, start, end) in order of ends; of finds of a template with one start, the first."""
        out, last = [], {}
        state = 0
        for i, word in enumerate(map(self.alphabet.get, words)):
            to = self.table[state].get(word)
            state = self._step(state, word) if to is None else to
            for k in self.found[state]:
                start = self._beginning(words, k, i + 1)
                if last.get(k) != start:
                    last[k] = start
                    out.append((k, start, i + 1))
        return out


@cache
def automaton(templates: tuple[str, ...]) -> Automaton:
    return Automaton(list(templates))


PLACES = "array<struct<label: string, phrase: boolean, start: long, end: long>>"


def license_places(df: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_words, and places (label, phrase or template, start and end word)."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    labels = [(label, True) for label in phrases.values()] + [(label, False) for label, _ in templates]
    wordings = (*phrases, *(t for _, t in templates))
    automaton(wordings)  # says here what is wrong with a template
    shape = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        find = automaton(wordings).places
        for batch in in_slices(batches):
            counts, places = [], []
            for raw in batch.column("raw").to_pylist():
                words = words_of(raw or b"")
                counts.append(len(words))
                places.append([{"label": labels[k][0], "phrase": labels[k][1], "start": a, "end": b} for k, a, b in find(words)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(places, shape)], names=["id", "n_words", "places"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, n_words long, places {PLACES}").withColumnRenamed("id", id_col)


def license_scan(df: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels and score.

    The score is 1 where a template's whole mandatory wording stands, 0.5 where only a phrase does, else 0.
    """
    found = license_places(df, phrases, templates, id_col, text_col)
    base = F.filter("places", lambda p: p["phrase"])
    starts = F.transform(base, lambda p: p["start"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    whole = F.exists("places", lambda p: ~p["phrase"])
    return found.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("places")).alias("labels"),
        F.when(whole, SURE).when(F.size(base) > 0, NAMED).otherwise(0.0).alias("score"),
    )
