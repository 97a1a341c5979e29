"""Iterating over a shuffled corpus from a training process."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frames, records, shuffle
from ..operators.errors import UsageError
from ..sources import units

MODES = ("none", "buffer", "reservoir", "chunk-shuffled", "index-perm")


class Dataset:
    """Records of ``df`` (id, record and, by mode, pos or frame_id) as bytes, epoch by epoch.

    ``sample`` caps records in total or, with ``sample_scope="epoch"``, in each
    epoch; 0 gives none. ``epochs=0`` never ends. ``seen`` records of the first
    epoch are passed over. Ranks get every ``world_size``-th record; so do the
    workers of ``worker_info``, a function that gives (worker, workers).
    ``counts`` has the number of records handed out in each epoch so far.
    """

    def __init__(self, df: DataFrame, shuffle: str = "chunk-shuffled", seed: int = 0, epochs: int = 1, sample: int | None = None, sample_scope: str = "total", rank: int | None = None, world_size: int | None = None, seen: int = 0, size: int | None = None, worker_info: Callable[[], tuple[int, int] | None] | None = None):
        if shuffle not in MODES:
            raise UsageError(f"unknown mode {shuffle!r}; there are {MODES}")
        self.df, self.mode, self.seed, self.epochs, self.sample, self.scope = df, shuffle, seed, epochs, sample, sample_scope
        self.rank, self.world, self.seen, self.size, self.worker_info = rank, world_size, seen, size, worker_info
        self.counts: dict[int, int] = {}

    def _ranks(self) -> tuple[int | None, int | None]:
        rank, world = self.rank, self.world
        worker = self.worker_info() if self.worker_info else None
        if worker:
            rank, world = (rank or 0) * worker[1] + worker[0], (world or 1) * worker[1]
        return rank, world

    def epoch(self, number: int) -> DataFrame:
        """record and out_pos of one epoch, for this rank."""
        rank, world = self._ranks()
        df, seed = self.df, self.seed
        if self.mode == "chunk-shuffled":
            out = shuffle.chunk_shuffled(df, seed, number, rank, world)
        elif self.mode == "index-perm":
            out = records.of_rank(shuffle.index_perm(df, seed, number), rank, world, "out_pos")
        else:
            out = records.of_rank(df, rank, world)
            if rank is not None and world:
                out = out.withColumn("pos", F.floor(F.col("pos") / world).cast("long"))
            if self.mode == "none":
                out = out.withColumn("out_pos", F.col("pos"))
            elif self.mode == "buffer":
                out = shuffle.buffer_shuffle(out, self.size or shuffle_default("buffer"), seed, number)
            else:
                out = shuffle.reservoir(out, self.size or shuffle_default("reservoir"), seed, number)
        return out.select(F.col("record").cast("binary").alias("record"), "out_pos")

    def __iter__(self) -> Iterator[bytes]:
        left = self.sample
        for number in itertools.count() if self.epochs == 0 else range(self.epochs):
            rows = self.epoch(number)
            if number == 0 and self.seen:
                rows = shuffle.resume(rows, self.seen)
            rows = rows.orderBy("out_pos")
            if self.sample is not None:
                if self.scope == "epoch":
                    left = self.sample
                if left <= 0:
                    return
                rows = rows.limit(left)
            self.counts[number] = 0
            for row in rows.toLocalIterator(prefetchPartitions=True):
                self.counts[number] += 1
                if left is not None:
                    left -= 1
                yield bytes(row["record"] or b"") + b"\n"


class UnitDataset(Dataset):
    """A ``Dataset`` over placed units of files (see ``sources.units``): texts are read when they are handed out.

    In file order and by chunks nothing is sorted, and a rank's chunks alone are read; a permutation is one of
    positions, and a sample of it reads the units that hold its records. ``max_line``: longer records are passed over
    and added to ``dropped``.
    """

    def __init__(self, units: DataFrame, *args, max_line: int | None = None, dropped=None, **more):
        super().__init__(units, *args, **more)
        if self.mode not in UNIT_MODES:
            raise UsageError(f"{self.mode} shuffles records, not units")
        self.max_line, self.dropped = max_line, dropped
        self.total, self.size_of_all = units.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("records", "bytes"))).first()

    def epoch(self, number: int, first: int | None = None) -> DataFrame:
        """record and, of a permutation, out_pos, in order over the partitions. ``first`` rows of a permutation are enough."""
        rank, world = self._ranks()
        if self.mode == "chunk-shuffled":
            return units.chunk_shuffled(self.df, self.seed, number, rank, world, out_pos=False).select("record")
        if self.mode == "none":
            return records.of_rank(units.records_of(self.df), rank, world).select("record")
        positions = self.df.sparkSession.range(self.total).select(F.col("id").alias("pos"))
        if first is not None and first < self.total:
            order = shuffle.sample(positions, first, self.seed, number, "pos")
        else:
            order, first = shuffle.index_perm(positions, self.seed, number, "pos"), self.total
        found = units.at_positions(self.df, records.of_rank(order, rank, world, "out_pos")).select("record", "out_pos")
        parts = max(1, -(-self.size_of_all * first // max(1, self.total) // units.TASK_BYTES))
        part = F.expr(f"CAST(out_pos * {parts} div {max(1, first)} AS INT)")  # places are known, so no sample of the texts decides where they go
        return found.repartitionById(parts, part).sortWithinPartitions("out_pos")

    def __iter__(self) -> Iterator[bytes]:
        left = self.sample
        world = self._ranks()[1] or 1
        for number in itertools.count() if self.epochs == 0 else range(self.epochs):
            left = self.sample if self.scope == "epoch" else left
            if left is not None and left <= 0:
                return
            skipped = self.seen if number == 0 else 0
            whole = left is None or self.max_line is not None  # records that are passed over make room for others
            rows = self.epoch(number, None if whole else (left + skipped) * world) if self.mode == "index-perm" else self.epoch(number)
            self.counts[number] = 0
            for row in itertools.islice(rows.toLocalIterator(prefetchPartitions=True), skipped, None):
                if self.max_line is not None and len(row["record"]) + 1 > self.max_line:
                    if self.dropped is not None:
                        self.dropped.add(1)
                    continue
                self.counts[number] += 1
                yield bytes(row["record"]) + b"\n"
                if left is not None:
                    left -= 1
                    if not left:
                        break


UNIT_MODES = ("none", "chunk-shuffled", "index-perm")


def shuffles_units(found: DataFrame, mode: str) -> bool:
    """Whether ``mode`` reads placed units as they are; files without chunks are chunk-shuffled by frames of their records."""
    return mode in UNIT_MODES and not (mode == "chunk-shuffled" and found.filter(F.col("kind").isin(*units.WHOLE)).first())


def of_units(found: DataFrame, mode: str, *args, frame_size: int = frames.DEFAULT_FRAME, **more) -> Dataset:
    """The dataset of placed units that suits ``mode``."""
    if shuffles_units(found, mode):
        return UnitDataset(found, mode, *args, **more)
    rows = units.records_of(found)
    return Dataset(frames.assign_frames(rows, frame_size, in_order=True) if mode == "chunk-shuffled" else rows, mode, *args, **more)


def shuffle_default(mode: str) -> int:
    return shuffle.DEFAULT_BUFFER if mode == "buffer" else shuffle.DEFAULT_RESERVOIR
