"""What every order of some filters removes at each step, and what each filter is worth.

A row's failures are a mask, a bit a filter, so the rows of a part fall into a
few cells (2^filters at most) whatever their number, and any step of any order
is a sum of cells. All orders are visited by swaps of neighbours, one a time
(Steinhaus, Johnson and Trotter): a swap changes what the two swapped steps do
and nothing else, so only these are summed again. A filter's removals are added
up along the walk; divided by the number of orders they are its Shapley value.

Texts are read whole, null ones as empty. A text that several rows share fails
the last filter in all rows but those of its least id; such texts are found by a
128-bit hash, and a very frequent one is joined by broadcast, so its rows don't
meet in one task. Rows that repeat an id and a text repeat no *smaller* id; null
ids are neither smaller nor greater than others. A document is good or toxic if
any of its labels says so. Null parts are the empty string. An empty table has
no parts and gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_slices, join_by_key

FEWEST_WORDS = 200
LEAST_DISTINCT, MOST_CAPITALS = 50, 3  # in a hundred
SYMBOL = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
FOLLOWING = bytes(range(0x80, 0xC0))  # all but the first bytes of code points
LETTERS = "ABCDE"
REPEATED = 1 << LETTERS.index("E")


def text_mask(raw: bytes) -> int:
    """Failures of a text by itself: few words, repeated words, many capitals, symbols."""
    words = raw.split()  # at the six ASCII spaces, as bytes
    capitals, points = (len(raw) - len(raw.translate(None, drop)) for drop in (CAPITALS, FOLLOWING))
    points = len(raw) - points
    fails = len(words) < FEWEST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * points, SYMBOL.search(raw) is not None
    return sum(1 << i for i, f in enumerate(fails) if f)


def masked(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per row: id, part, digest of the text, mask of all filters but the last, good, toxic."""

    def run(batches):
        for batch in in_slices(batches):
            raw = [x or b"" for x in batch.column("raw").to_pylist()]
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array([text_mask(x) for x in raw], pa.int32())], names=["id", "part", "digest", "mask"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("binary").alias("raw"))
    masks = rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, part string, digest binary, mask int")
    says = lambda c: F.max((F.col(c) == 1).cast("int"))
    labelled = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    return masks.join(labelled, "id", "left").select("id", "part", "digest", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def mask_cells(rows: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the rows of ``masked`` by their failures of all filters, repeated texts included."""
    rows = cut(rows)
    shared = cut(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL"))
    repeats = join_by_key(rows, shared, "digest", "n").filter("id > first")
    count = lambda df, sign: [(F.sum(c) * sign).alias(c) for c in ("n", "good", "toxic")]
    every = rows.withColumn("n", F.lit(1)).groupBy("part", "mask").agg(*count(rows, 1))
    again = cut(repeats.withColumn("n", F.lit(1)).groupBy("part", "mask").agg(*count(repeats, 1)))  # a few rows a part
    moved = again.withColumn("mask", F.col("mask") + REPEATED)
    parts = every.unionByName(moved).unionByName(again.select("part", "mask", *(-F.col(c).alias(c) for c in ("n", "good", "toxic"))).toDF("part", "mask", "n", "good", "toxic"))
    return parts.groupBy("part", "mask").agg(*count(parts, 1))


def swaps(n: int) -> Iterator[int]:
    """Places i of the swaps (i, i + 1) that lead through all orders of ``n`` things: the last one sweeps through each order of the others."""
    if n < 2:
        return
    others, down = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        turn = next(others, None)
        if turn is None:
            return
        yield turn + down  # the last one stands before the others after its way down
        down = not down


def walk(cells: np.ndarray, letters: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders; for each the figures of its steps (orders, steps, parts, figures); removals by filter over all orders (filters, parts).

    ``cells``: rows, good and toxic ones by part and mask. Figures: kept, removed, redundant, good and toxic ones removed.
    """
    n = len(letters)
    masks = np.arange(1 << n)

    def step(before: int, f: int) -> np.ndarray:
        fails, reached = masks & (1 << f) != 0, masks & before == 0
        removed = cells[:, :, fails & reached].sum(axis=2)
        kept, redundant = (cells[0][:, c].sum(axis=1) for c in (~fails & reached, fails & ~reached))
        return np.stack([kept, removed[0], redundant, removed[1], removed[2]], axis=1)

    order = list(range(n))
    steps = [step(sum(1 << g for g in order[:i]), f) for i, f in enumerate(order)]
    orders, figures, worth = [], [], np.zeros((n, cells.shape[1]), dtype=np.int64)
    for at in [None, *swaps(n)]:
        if at is not None:
            order[at], order[at + 1] = order[at + 1], order[at]
            before = sum(1 << g for g in order[:at])
            steps[at], steps[at + 1] = step(before, order[at]), step(before | 1 << order[at], order[at + 1])
        orders.append("".join(letters[f] for f in order))
        figures.append(np.stack(steps))
        for f, s in zip(order, steps):
            worth[f] += s[:, 1]
    return orders, np.stack(figures), worth


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Per part, order of filters and step: filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``cells`` has part, mask (a bit a letter), n, good, toxic, one row a part and mask.
    """
    n = len(letters)
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def run(batches):
        for batch in in_slices(batches, 64):
            held = np.zeros((3, batch.num_rows, 1 << n), dtype=np.int64)
            for i, own in enumerate(batch.column("cells").to_pylist()):
                for c in own:
                    held[:, i, c["mask"]] = c["n"], c["good"], c["toxic"]
            orders, figures, worth = walk(held, letters)
            place = np.array([[letters.index(f) for f in o] for o in orders])  # orders, steps
            alone = held[0][:, 1 << place]  # parts, orders, steps
            by_part = figures.transpose(2, 0, 1, 3)
            out = [by_part[..., 0], by_part[..., 1], by_part[..., 2], alone, by_part[..., 3], by_part[..., 4], worth.T[:, place]]
            each = len(orders) * n
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("part").take(pa.array(np.repeat(np.arange(batch.num_rows), each))),
                    pa.array([o for _ in range(batch.num_rows) for o in orders for _ in range(n)], pa.string()),
                    pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), batch.num_rows * len(orders))),
                    pa.array([f for _ in range(batch.num_rows) for o in orders for f in o], pa.string()),
                    *(pa.array(x.reshape(-1)) for x in out),
                ],
                names=["part", "filter_order", "step", "filter", *columns],
            )

    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^filters at most
    return by_part.mapInArrow(run, "part string, filter_order string, step int, filter string, " + ", ".join(f"{c} long" for c in columns))


def filter_audit(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of the five filters over documents."""
    return interactions(mask_cells(masked(df, labels)))
