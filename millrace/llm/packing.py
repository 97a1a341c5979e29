"""Packing documents into sequences of a fixed capacity by length patterns.

Only the histogram of piece lengths, at most ``capacity`` numbers however many
documents there are, decides the packing, in rounds. A round enumerates patterns
of a few different lengths, each with a number of pieces, that fill a sequence
to within SLACK (or leave too little for any length there is); non-negative
least squares fits how often each pattern should repeat to use the histogram up;
the counts are rounded to whole ones that the histogram has, and the lengths
left over are the next round's histogram. When few pieces are left, or a round
places few, those are packed best fit. The plan then says, for the r-th piece of
a length, which sequence and offset it gets; numbering the pieces of a length is
two-level, so that a length shared by a third of all pieces isn't numbered in
one task.

Null texts are empty ones and still have the end id; very long texts are encoded
whole, one at a time, and cut into pieces. Rows with equal or null ids are
separate documents and kept; pieces of one length are ranked by id and piece,
and which of two equal rows comes first doesn't matter. An empty table gives no
rows. Columns of other names are dropped, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, in_byte_slices, in_slices
from .tokens import crc32_of, encode_column

#: Patterns that a round enumerates: four times as many as there are lengths.
PATTERNS_A_LENGTH = 4
FIT_ROUNDS = 300
#: A pattern may leave so much of the capacity empty.
SLACK = 1 / 1024
#: Different lengths that a pattern draws before it is closed, and pairs that are tried to close it.
DRAWS, PAIRS_TRIED = 12, 24
#: Best fit packs what is left once it is so small a share, or a round places no more than a tenth of its pieces.
RESIDUAL, LEAST_PROGRESS = 0.02, 0.1
MOST_ROUNDS = 16


def piece_table(df: DataFrame, path: str, capacity: int, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32. Only documents longer than ``capacity`` are cut."""

    def run(batches):
        for batch in in_byte_slices(in_slices(batches), "text"):
            ids, bounds = encode_column(batch.column("text"), path, end_id)
            lengths = np.diff(bounds)
            counts = -(-lengths // capacity)
            row = np.repeat(np.arange(len(lengths)), counts)
            number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = number * capacity
            length = np.minimum(capacity, lengths[row] - start)
            begin = bounds[row] + start
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc32_of(ids, begin, begin + length), pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


class Patterns:
    """Entries (pattern, length, pieces), ascending, of ``n`` patterns."""

    def __init__(self, pattern: np.ndarray, length: np.ndarray, pieces: np.ndarray):
        names, self.pattern = np.unique(pattern, return_inverse=True)
        self.length, self.pieces, self.n = length, pieces, len(names)
        self.bounds = np.searchsorted(self.pattern, np.arange(self.n + 1))


def enumerate_patterns(histogram: np.ndarray, capacity: int, wanted: int, seed: int) -> Patterns:
    """``wanted`` patterns over the lengths of the histogram, drawn side by side.

    Every length begins as many patterns as any other. A pattern goes on with
    lengths drawn by their share of the pieces until its gap is below a level of
    its own, uniform over the capacity, and is then closed by one or two lengths
    that fill the gap exactly, where some are found, so that long and short
    lengths alike end patterns.
    """
    draw = np.random.default_rng(seed)
    there = histogram > 0
    mass = np.cumsum(histogram.astype(np.float64))
    lengths = np.flatnonzero(there)
    largest_within = np.maximum.accumulate(np.where(there, np.arange(len(histogram)), 0))
    slack = int(capacity * SLACK)
    gap = np.full(wanted, capacity, dtype=np.int64)
    close_from = np.ceil(capacity * draw.random(wanted)).astype(np.int64)
    entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(who: np.ndarray, length: np.ndarray, pieces: np.ndarray | None = None) -> None:
        pieces = np.ones(len(who), dtype=np.int64) if pieces is None else pieces
        entries.append((who, length, pieces))
        gap[who] -= length * pieces

    def drawn(room: np.ndarray, shape) -> np.ndarray:
        """Lengths of at most ``room``, by their share of the pieces of such lengths."""
        return np.minimum(np.searchsorted(mass, draw.random(shape) * mass[room], side="right"), room)

    everyone = np.arange(wanted)
    put(everyone, lengths[everyone * len(lengths) // wanted if wanted < len(lengths) else everyone % len(lengths)])
    step = 1
    while True:
        open_ones = everyone[(gap > slack) & (largest_within[gap] > 0)]
        if not len(open_ones) or step > min(4 * DRAWS, histogram.sum()):
            break
        closing = (gap[open_ones] <= close_from[open_ones]) | (step >= DRAWS)
        exact = closing & there[gap[open_ones]]
        who = open_ones[exact]
        put(who, gap[who])
        who = open_ones[closing & ~exact]
        room = gap[who]
        first = drawn(room[:, None], (len(who), PAIRS_TRIED))
        second = room[:, None] - first
        fills = there[first] & there[second] & ((first != second) | (histogram[first] > 1)) & (second > 0)
        k, row = fills.argmax(axis=1), np.arange(len(who))
        found = fills[row, k]
        put(who[found], first[row, k][found])
        put(who[found], second[row, k][found])
        who = np.concatenate([open_ones[~closing], who[~found]])
        room = gap[who]
        length = drawn(room, len(who)) if step < 2 * DRAWS else largest_within[room]
        put(who, length, np.clip(room // (length * max(1, DRAWS - step)), 1, np.minimum(histogram[length], room // length)))
        step += 1
    pattern, length, pieces = (np.concatenate(x) for x in zip(*entries))
    one, inverse = np.unique(pattern * (capacity + 1) + length, return_inverse=True)
    pieces = np.bincount(inverse, pieces, len(one)).astype(np.int64)
    pattern, length = one // (capacity + 1), one % (capacity + 1)
    mark = np.bincount(pattern, draw.random(capacity + 1)[length] * pieces, wanted)  # equal for equal patterns
    once = np.zeros(wanted, dtype=bool)
    once[np.unique(mark, return_index=True)[1]] = True
    possible = (once & (np.bincount(pattern, pieces > histogram[length], wanted) == 0))[pattern]
    return Patterns(pattern[possible], length[possible], pieces[possible])


def fit_counts(patterns: Patterns, histogram: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts whose use of lengths is nearest to the histogram in least squares.

    Multiplicative updates keep the counts non-negative; lengths are weighted by
    the inverse of their number, so that rare ones count too.
    """
    which, length, pieces = patterns.pattern, patterns.length, patterns.pieces
    weight = 1 / np.maximum(histogram, 1.0)
    up = np.bincount(which, (histogram * weight)[length] * pieces, patterns.n)
    counts = np.full(patterns.n, (histogram * np.arange(len(histogram))).sum() / max(1, len(histogram) - 1) / max(1, patterns.n))
    for _ in range(FIT_ROUNDS):
        used = np.bincount(length, counts[which] * pieces, len(histogram))
        counts *= up / np.maximum(np.bincount(which, (used * weight)[length] * pieces, patterns.n), 1e-12)
    return counts


#: Lengths of a sequence with their numbers of pieces, and how many such sequences.
Packed = list[tuple[tuple[tuple[int, int], ...], int]]


def by_patterns(histogram: np.ndarray, capacity: int) -> tuple[Packed, np.ndarray]:
    """What fitted patterns pack, and the histogram that is left."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    total = int(left.sum())
    out: Packed = []
    if left[capacity]:
        out.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    for seed in range(MOST_ROUNDS):
        before = int(left.sum())
        if before <= RESIDUAL * total:
            break
        patterns = enumerate_patterns(left, capacity, PATTERNS_A_LENGTH * capacity, seed)
        counts = fit_counts(patterns, left.astype(np.float64))
        most = counts.sum()
        for k in np.argsort(-counts, kind="stable").tolist():
            if most <= 0:
                break
            own = slice(patterns.bounds[k], patterns.bounds[k + 1])
            length, pieces = patterns.length[own], patterns.pieces[own]
            times = min(max(1, int(counts[k])), int((left[length] // pieces).min()))
            if times:
                left[length] -= pieces * times
                out.append((tuple(zip(length.tolist(), pieces.tolist())), times))
                most -= times
        if before - int(left.sum()) <= LEAST_PROGRESS * before:
            break
    return out, left


def best_fit(histogram: np.ndarray, capacity: int) -> Packed:
    """Every piece of the histogram, the longest first, each gap by the longest that fits or two that fill it."""
    left = histogram.copy()
    out: Packed = []
    while left.any():
        pattern: dict[int, int] = {}
        gap = capacity
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            if pattern:
                fits = fits[[left[x] > pattern.get(x, 0) for x in fits.tolist()]]
            if not len(fits):
                break
            pick = int(fits[-1])
            if pattern and pick < gap and len(fits) > 1:  # two that fill the gap are better than one that doesn't
                pairs = gap - fits
                both = fits[(pairs > 0) & np.isin(pairs, fits) & (pairs != fits)]
                pick = int(both[-1]) if len(both) else pick
            pattern[pick] = pattern.get(pick, 0) + 1
            gap -= pick
        times = min(int(left[x]) // n for x, n in pattern.items())
        out.append((tuple(pattern.items()), times))
        for x, n in pattern.items():
            left[x] -= n * times
    return out


def plan(histogram: np.ndarray, capacity: int) -> Packed:
    """A packing that uses every piece of the histogram once."""
    fitted, left = by_patterns(histogram, capacity)
    return fitted + best_fit(left, capacity)


class Placement:
    """For the r-th piece of a length: its sequence and offset. As large as the plan."""

    def __init__(self, packed: Packed, capacity: int):
        used = np.zeros(capacity + 1, dtype=np.int64)
        rows = []
        sequence = 0
        for pattern, times in packed:
            at = 0
            for length, pieces in pattern:
                rows.append((length, used[length], sequence, pieces, at))
                used[length] += times * pieces
                at += length * pieces
            sequence += times
        self.n_sequences = sequence
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        self.step = int(used.max()) + 1
        self.keys = table[:, 0] * self.step + table[:, 1]
        self.base, self.first, self.pieces, self.offset = table[:, 1:].T.copy()

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, lengths * self.step + ranks, side="right") - 1
        within = ranks - self.base[at]
        return self.first[at] + within // self.pieces[at], self.offset[at] + within % self.pieces[at] * lengths


def pack(df: DataFrame, path: str, capacity: int = 4096, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    pieces = cut(piece_table(df, path, capacity, end_id, id_col, text_col).filter("length > 0")).withColumn("part", F.spark_partition_id())
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    totals = per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in totals:
        histogram[r["length"]] = r["n"]
    placement = spark.sparkContext.broadcast(Placement(plan(histogram, capacity), capacity))  # as large as the histogram
    before = per_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    numbered = pieces.withColumn("within", F.row_number().over(Window.partitionBy("part", "length").orderBy("id", "piece")) - 1)
    ranked = numbered.join(before, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))

    def place(batches):
        for batch in batches:
            sequence, offset = placement.value(batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
