"""Pair merging of byte-pair encodings, and a bounded memory of what was merged."""

from __future__ import annotations

import heapq
from sys import getsizeof

#: Longer inputs go through a heap, so that a run of a million letters stays near linear.
HEAP_FROM = 64
NO_RANK = 1 << 60


def merge(parts: list, ranks: dict, between=b"") -> list:
    """``parts`` joined pair by pair, lowest rank first and leftmost on ties.

    The rank of a pair is ``ranks[left + between + right]``.
    """
    if len(parts) >= HEAP_FROM:
        return _merge_with_heap(parts, ranks, between)
    get = ranks.get
    near = [get(a + between + b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while near:
        best = min(near)
        if best == NO_RANK:
            break
        i = near.index(best)
        parts[i] += parts.pop(i + 1)
        near.pop(i)
        if i < len(near):
            near[i] = get(parts[i] + between + parts[i + 1], NO_RANK)
        if i:
            near[i - 1] = get(parts[i - 1] + between + parts[i], NO_RANK)
    return parts


def _merge_with_heap(parts: list, ranks: dict, between) -> list:
    n = len(parts)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []

    def offer(i: int, j: int) -> None:
        rank = ranks.get(parts[i] + between + parts[j])
        if rank is not None:
            heapq.heappush(heap, (rank, i, parts[i], parts[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if j >= n or parts[i] != left or parts[j] != right:
            continue  # one side has been merged since
        parts[i] = left + right
        parts[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            offer(i, k)
        if before[i] >= 0:
            offer(before[i], i)
    return [p for p in parts if p is not None]


class Remembered(dict):
    """Values of ``work`` by string; two generations of at most ``room`` bytes each are kept, long keys never.

    What is met again while in the older generation goes into the newer one, without being worked out anew.
    """

    room = 80 << 20
    longest = 64
    #: Bytes of an entry in a table, besides its key and value.
    beside = 96

    def __init__(self):
        super().__init__()
        self.old: dict = {}
        self.held = 0

    def work(self, key: str):
        raise NotImplementedError

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if len(key) <= self.longest:
            if self.held >= self.room:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self.held += getsizeof(key) + getsizeof(value) + self.beside
            self[key] = value
        return value
