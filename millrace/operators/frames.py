"""Record-aligned frames, their statistics, and the index of record places."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import cut, running_before

DEFAULT_FRAME = 2 << 20


def _closing(ends: np.ndarray, base: np.ndarray | int, frame_size: int) -> np.ndarray:
    """Index of the record that closes a frame begun after ``base`` bytes; len(ends) if none does. ``ends``: running bytes."""
    return np.searchsorted(ends, base + frame_size)


class _Exits:
    """How a run of records leaves the frame that it finds open.

    ``low[k]`` is the least number of bytes held at its beginning with which
    record k is the first to close a frame; then ``held[k]`` bytes are held at
    its end, after ``closed[k]`` frames. With fewer bytes none closes.
    """

    def __init__(self, sizes: np.ndarray, frame_size: int):
        ends = np.cumsum(sizes)
        self.total = int(ends[-1])
        last = min(len(ends) - 1, int(_closing(ends, 0, frame_size)))  # the first to close from an empty frame
        self.low = np.maximum(0, frame_size - ends[: last + 1])
        start = np.arange(1, last + 2)  # where the next frame begins
        held, closed = np.zeros(last + 1, dtype=np.int64), np.ones(last + 1, dtype=np.int64)
        going = np.arange(last + 1)
        while len(going):
            base = ends[start[going] - 1]
            at = _closing(ends, base, frame_size)
            over = at >= len(ends)
            held[going[over]] = self.total - base[over]
            going, at = going[~over], at[~over]
            closed[going] += 1
            start[going] = at + 1
        self.held, self.closed = held, closed


@dataclass
class _Run:
    """What a run of records, of one file or several, does to the frame that is open at its beginning.

    ``low``, ``held`` and ``closed`` are the exits of a run of one file (see _Exits), with those that end alike joined.
    A run of several files leaves ``frames`` and ``left`` bytes of its last one, whatever it finds.
    """

    first: str
    last: str
    single: bool
    total: int
    low: np.ndarray
    held: np.ndarray
    closed: np.ndarray
    frames: int
    left: int

    def leave(self, frame: int, held: int) -> tuple[int, int]:
        """Frame and bytes open at the end of a run, if it begins in the file that ``frame`` counts in."""
        if not self.single:
            return self.frames, self.left
        k = int(np.searchsorted(-self.low, -held))
        return (frame + int(self.closed[k]), int(self.held[k])) if k < len(self.low) else (frame, held + self.total)

    def follow(self, file: str | None, frame: int, held: int) -> tuple[str, int, int]:
        """The state behind a run that begins in the state (file, frame, held)."""
        return self.last, *self.leave(*((frame, held) if file == self.first else (0, 0)))


NOTHING = np.zeros(0, dtype=np.int64)


def _joined(low: np.ndarray, held: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exits without those that end as the next one does, which begins with fewer bytes."""
    keep = np.append((held[1:] != held[:-1]) | (closed[1:] != closed[:-1]), True)[: len(low)]
    return low[keep], held[keep], closed[keep]


def _then(a: _Run, b: _Run) -> _Run:
    """Two runs as one."""
    if a.single and b.single and a.last == b.first:
        k = np.searchsorted(-b.low, -a.held)  # where the exits of a come into b
        inside = k < len(b.low)
        at = np.minimum(k, max(0, len(b.low) - 1))
        held = np.where(inside, b.held[at], a.held + b.total) if len(b.low) else a.held + b.total
        closed = a.closed + (np.where(inside, b.closed[at], 0) if len(b.low) else 0)
        # with fewer bytes nothing closes in a, and b is entered with all of its bytes besides
        floor = int(a.low[-1]) if len(a.low) else None
        more = np.maximum(0, b.low - a.total)
        use = np.flatnonzero(more < floor) if floor is not None else np.arange(len(more))
        zero = np.flatnonzero(more[use] == 0)
        use = use[: zero[0] + 1] if len(zero) else use
        exits = (np.concatenate(x) for x in ((a.low, more[use]), (held, b.held[use]), (closed, b.closed[use])))
        return _Run(a.first, b.last, True, a.total + b.total, *_joined(*exits), 0, 0)
    state = b.follow(a.last, a.frames, a.left) if not a.single else b.follow(None, 0, 0) if a.last != b.first else None
    if state is None:  # b is of several files
        state = b.last, b.frames, b.left
    return _Run(a.first, b.last, False, 0, NOTHING, NOTHING, NOTHING, state[1], state[2])


_LISTS = pa.list_(pa.int64())
_RUN = pa.schema([("part", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("single", pa.bool_()), ("total", pa.int64()), ("low", _LISTS), ("held", _LISTS), ("closed", _LISTS), ("frames", pa.int64()), ("left", pa.int64())])
_RUN_TEXT = "part long, first string, last string, single boolean, total long, low array<long>, held array<long>, closed array<long>, frames long, left long"
#: Runs that are composed in one task: at most so many times the exits of one.
RUNS_AT_ONCE = 64


def _as_batch(part: int, run: _Run) -> pa.RecordBatch:
    columns = [pa.array([part if n == "part" else getattr(run, n)], _RUN.field(n).type) for n in _RUN.names]
    return pa.RecordBatch.from_arrays(columns, schema=_RUN)


def _as_runs(table: pa.Table) -> list[tuple[int, _Run]]:
    """Runs of a table in the order of their parts."""
    table = table.sort_by("part").combine_chunks()
    lists = {n: table.column(n) for n in ("low", "held", "closed")}
    numbers = lambda n, i: np.asarray(lists[n][i].values.to_numpy(), dtype=np.int64)
    return [(r["part"], _Run(r["first"], r["last"], r["single"], r["total"], *(numbers(n, i) for n in lists), r["frames"], r["left"])) for i, r in enumerate(table.select(["part", "first", "last", "single", "total", "frames", "left"]).to_pylist())]


def _run_of(sizes: np.ndarray, names: list[str], lengths: list[int], frame_size: int) -> _Run:
    """The run of records of ``sizes``, ``lengths`` of them of each file in turn."""
    if len(names) == 1:
        e = _Exits(sizes, frame_size)
        return _Run(names[0], names[0], True, e.total, *_joined(e.low, e.held, e.closed), 0, 0)
    e = _Exits(sizes[len(sizes) - lengths[-1] :], frame_size)
    k = len(e.low) - 1
    frames, left = (int(e.closed[k]), int(e.held[k])) if e.low[k] == 0 else (0, e.total)
    return _Run(names[0], names[-1], False, 0, NOTHING, NOTHING, NOTHING, frames, left)


def _frames_before(narrow: DataFrame, frame_size: int) -> dict[int, tuple[int, int]]:
    """For each partition of ``narrow`` (__part, __file, nbytes): the frame open at its beginning and the bytes in it.

    What a partition does to the open frame depends only on the bytes in it, and
    at most as many records can be the first to close it as fit in a frame. So
    each partition, on its own, gives one row with its exits. Rows are composed
    RUNS_AT_ONCE at a time, level by level, until few are left; then the state at
    the beginning of each goes down again, level by level, to the partitions.
    """

    def exits(batches):
        files, sizes, part = [], [], None
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
                files.append(pc.run_end_encode(batch.column(1)))
                sizes.append(batch.column(2).to_numpy(zero_copy_only=False))
        if part is None:
            return
        names, lengths = [], []
        for column in files:
            ends = column.run_ends.to_numpy()
            for name, n in zip(column.values.to_pylist(), np.diff(ends, prepend=0).tolist()):
                if names and names[-1] == name:
                    lengths[-1] += n
                else:
                    names.append(name)
                    lengths.append(n)
        yield _as_batch(part, _run_of(np.concatenate(sizes).astype(np.int64), names, lengths, frame_size))

    levels = [cut(narrow.mapInArrow(exits, _RUN_TEXT))]
    group = F.expr(f"part div {RUNS_AT_ONCE}")

    def compose(table: pa.Table) -> pa.Table:
        runs = _as_runs(table)
        return pa.Table.from_batches([_as_batch(runs[0][0] // RUNS_AT_ONCE, reduce(_then, (r for _, r in runs)))])

    while (levels[-1].agg(F.max("part")).first()[0] or 0) >= RUNS_AT_ONCE:
        levels.append(cut(levels[-1].withColumn("group", group).groupBy("group").applyInArrow(lambda t: compose(t.drop_columns(["group"])), _RUN_TEXT)))
    states = narrow.sparkSession.createDataFrame([(0, None, 0, 0)], "group long, file string, frame long, held long")
    kinds = "group long, file string, frame long, held long"

    def descend(runs: pa.Table, state: pa.Table) -> pa.Table:
        """The state before each run of a group, from that before the group."""
        now = tuple(state.select(["file", "frame", "held"]).to_pylist()[0].values()) if state.num_rows else (None, 0, 0)
        out = []
        for part, run in _as_runs(runs.drop_columns(["group"])) if runs.num_rows else []:
            out.append((part, *now) if now[0] == run.first else (part, None, 0, 0))
            now = run.follow(*now)
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["group", "file", "frame", "held"])

    for level in reversed(levels):
        states = cut(level.withColumn("group", group).groupBy("group").cogroup(states.groupBy("group")).applyInArrow(descend, kinds))
    found = states.select("group", "frame", "held").collect()  # three numbers a partition, that is a task
    return {r["group"]: (r["frame"], r["held"]) for r in found}


def assign_frames(df: DataFrame, frame_size: int = DEFAULT_FRAME, position: str = "pos", file: str | None = None, in_order: bool = False) -> DataFrame:
    """``df`` with frame_id: a frame closes with the first record at which it holds ``frame_size`` bytes or more.

    Records are dealt by range of their position, in each file if ``file`` is
    given, and every partition numbers its own frames once it knows which one is
    open at its beginning. ``in_order``: ``df`` comes from ``with_position`` and
    lies so already.
    """
    by = [*([file] if file else []), position]
    dealt = df if in_order else cut(df.repartitionByRange(*by).sortWithinPartitions(*by))
    dealt = dealt.withColumn("__part", F.spark_partition_id())
    columns = [f.name for f in dealt.schema.fields]
    narrow = dealt.select("__part", (F.col(file).cast("string") if file else F.lit("")).alias("__file"), "nbytes")
    entry = df.sparkSession.sparkContext.broadcast(_frames_before(narrow, frame_size))

    def number(batches):
        current, frame, held, begun = None, 0, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(columns.index("nbytes")).to_numpy(zero_copy_only=False).astype(np.int64)
            runs = [(current if begun else None, len(sizes))]
            if file:
                coded = pc.run_end_encode(pc.cast(batch.column(columns.index(file)), pa.string()))
                runs = list(zip(coded.values.to_pylist(), np.diff(coded.run_ends.to_numpy(), prepend=0).tolist()))
            if not begun:
                frame, held = entry.value[batch.column(len(columns) - 1)[0].as_py()]
                current, begun = runs[0][0], True
            out, at = np.empty(len(sizes), dtype=np.int32), 0
            for name, n in runs:
                if name != current:
                    current, frame, held = name, 0, 0
                ends, base, first = np.cumsum(sizes[at : at + n]), -held, 0
                while (k := int(_closing(ends, base, frame_size))) < n:
                    out[at + first : at + k + 1] = frame
                    frame, base, first = frame + 1, int(ends[k]), k + 1
                out[at + first : at + n] = frame
                held, at = int(ends[-1]) - base, at + n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*columns[:-1], "frame_id"])

    kinds = T.StructType([*dealt.schema.fields[:-1], T.StructField("frame_id", T.IntegerType())])
    return dealt.mapInArrow(number, kinds)


def frame_table(df: DataFrame, *files: str) -> DataFrame:
    """Per frame: records, bytes, and the byte offset where it starts."""
    sizes = df.groupBy(*files, "frame_id").agg(F.count("*").alias("records"), F.sum("nbytes").cast("long").alias("bytes"))
    return running_before(sizes, "frame_id", "bytes", files, "start")


def size_summary(sizes: DataFrame, size: str, *sums: str) -> DataFrame:
    """One row over frames: frames, the sums of ``size`` and ``sums``, min_frame, max_frame and median_frame, the upper median.

    Frames are grouped by size before they are put in order.
    """
    by_size = running_before(sizes.groupBy(size).agg(F.count("*").alias("__n"), *(F.sum(c).alias(c) for c in sums)), size, "__n").withColumn("__one", F.lit(1))
    number = by_size.groupBy("__one").agg(F.sum("__n").alias("__frames"))
    middle = F.floor(F.col("__frames") / 2)
    at_middle = (F.col("before") <= middle) & (middle < F.col("before") + F.col("__n"))
    return by_size.join(F.broadcast(number), "__one").agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("frames"),
        *(F.sum(c).cast("long").alias(c) for c in sums),
        F.sum(F.col(size) * F.col("__n")).cast("long").alias(size),
        F.min(size).alias("min_frame"),
        F.max(size).alias("max_frame"),
        F.max(F.when(at_middle, F.col(size))).alias("median_frame"),
    )


def frame_info(df: DataFrame) -> DataFrame:
    """One row: frames, records, bytes, least and largest frame, and the upper median of frame sizes."""
    return size_summary(df.groupBy("frame_id").agg(F.count("*").alias("records"), F.sum("nbytes").cast("long").alias("bytes")), "bytes", "records")


def record_index(df: DataFrame, position: str = "pos") -> DataFrame:
    """``df`` framed, with each record's frame_id, offset_in_frame and length."""
    within = F.sum("nbytes").over(Window.partitionBy("frame_id").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)) - F.col("nbytes")
    return df.select("id", F.col(position).alias("idx"), "frame_id", within.cast("long").alias("offset_in_frame"), F.col("nbytes").alias("length"))


def byte_offsets(df: DataFrame, position: str = "pos") -> DataFrame:
    """idx, start and end byte of every record in one file of records in order of ``position``."""
    placed = running_before(df.select("id", F.col(position).alias("idx"), "nbytes"), "idx", "nbytes", name="start")
    return placed.select("id", "idx", "start", (F.col("start") + F.col("nbytes")).cast("long").alias("end"))
