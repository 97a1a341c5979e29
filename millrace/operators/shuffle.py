"""Shuffle modes as plans: permutation, frame-local, bounded buffer, reservoir, and epochs.

Each gives ``out_pos``, the 0-based place of a row in the output, so that ranks,
resumption and limits are filters on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.prf import prf_hex, prf_mod, prf_unit
from .shared import running_before

DEFAULT_BUFFER = 100_000
DEFAULT_RESERVOIR = 10_000
#: Leading hexadecimal digits of the hash that deal rows to tasks: 65,536 ranges of equal chance, 1.5 million rows each at 10^11.
DEAL_DIGITS = 4


def place_by_hash(df: DataFrame, key: Column, *ties: str, groups: tuple[str, ...] = (), name: str = "out_pos") -> DataFrame:
    """Places in the order of a uniform hash, without sorting in one task.

    The hash's leading digits cut its range into equal parts. Their sizes, which
    need only the ids, give each part's first place; rows are ranked within
    parts. ``groups`` are placed separately.
    """
    keyed = df.withColumn("__h", key).withColumn("__deal", F.substring("__h", 1, DEAL_DIGITS))
    sizes = keyed.groupBy(*groups, "__deal").agg(F.count("*").alias("__n"))
    to_here = Window.partitionBy(*groups).orderBy("__deal").rowsBetween(Window.unboundedPreceding, 0) if groups else Window.partitionBy(F.lit(0)).orderBy("__deal").rowsBetween(Window.unboundedPreceding, 0)
    first = sizes.withColumn("__first", F.sum("__n").over(to_here) - F.col("__n")).drop("__n")  # at most 65,536 rows a group
    within = F.row_number().over(Window.partitionBy(*groups, "__deal").orderBy("__h", *ties)) - 1
    placed = keyed.withColumn("__within", within).join(first, [*groups, "__deal"])
    return placed.withColumn(name, (F.col("__first") + F.col("__within")).cast("long")).drop("__h", "__deal", "__within", "__first")


def index_perm(df: DataFrame, seed: int = 0, epoch: int = 0, id_col: str = "id") -> DataFrame:
    """A uniform permutation of all rows."""
    return place_by_hash(df, prf_hex(seed, "perm", epoch, id_col), id_col)


def with_epochs(df: DataFrame, epochs: int) -> DataFrame:
    """Every row once an epoch; modes then take the column epoch into their hash and their groups."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def index_perm_epochs(df: DataFrame, epochs: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """An independent permutation in each epoch."""
    return place_by_hash(with_epochs(df, epochs), prf_hex(seed, "perm", F.col("epoch"), id_col), id_col, groups=("epoch",))


def sample(df: DataFrame, n: int, seed: int = 0, epoch: int = 0, id_col: str = "id") -> DataFrame:
    """The first ``n`` rows of the permutation, by a top-k that sorts nothing else."""
    top = df.withColumn("__h", prf_hex(seed, "perm", epoch, id_col)).orderBy("__h", id_col).limit(n)
    return top.withColumn("out_pos", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__h", id_col)) - 1).cast("long")).drop("__h")


def resume(df: DataFrame, seen: int) -> DataFrame:
    """What is left after ``seen`` records."""
    return df.filter(F.col("out_pos") >= seen)


def frame_positions(frames: DataFrame, seed: int, epoch: int = 0) -> DataFrame:
    """frame_id and frame_pos, its place in the permutation of frames. One row a frame."""
    return place_by_hash(frames.select("frame_id").distinct(), prf_hex(seed, "perm", epoch, "frame_id"), "frame_id", name="frame_pos")


def chunk_shuffled(df: DataFrame, seed: int = 0, epoch: int = 0, rank: int | None = None, world: int | None = None, id_col: str = "id") -> DataFrame:
    """Frames permuted, rows permuted within frames. Ranks take whole frames, before any row is moved.

    ``df`` has frame_id. The result has frame_pos, rec_pos and out_pos among the rank's rows.
    """
    from .records import of_rank

    order = of_rank(frame_positions(df, seed, epoch), rank, world, "frame_pos")
    sizes = df.groupBy("frame_id").agg(F.count("*").alias("n")).join(order, "frame_id")
    before = running_before(sizes, "frame_pos", "n").drop("n")
    rec = F.row_number().over(Window.partitionBy("frame_id").orderBy(prf_hex(seed, "frame", epoch, "frame_id", id_col), id_col)) - 1
    return df.join(before, "frame_id").withColumn("rec_pos", rec.cast("long")).withColumn("out_pos", (F.col("before") + F.col("rec_pos")).cast("long")).drop("before")


def chunk_round_robin(df: DataFrame, seed: int = 0, epoch: int = 0, active: int | None = None, id_col: str = "id") -> DataFrame:
    """Rows of frames taken in turn; with ``active``, from so many frames at a time, mixed by hash.

    The result has the sort key (turn, rec_pos, frame_pos); rows of a turn lie together.
    """
    placed = chunk_shuffled(df, seed, epoch, id_col=id_col)
    turn = F.lit(0) if active is None else F.floor(F.col("frame_pos") / active)
    return placed.withColumn("turn", turn.cast("long")).drop("out_pos")


def interleaved(df: DataFrame, active: int = 8, seed: int = 0, epoch: int = 0, id_col: str = "id") -> DataFrame:
    """Rows of ``active`` frames at a time, mixed in proportion to the frames' sizes; a frame that ends makes room for the next.

    In virtual time every frame lasts as long, 1, however many rows it has: it
    hands them out evenly, each a random part of a step late. The first frames
    all begin at 0 and end one after the other, frame i at (i + 1) / active;
    then frame i begins when frame i - active ends. So each place in the order of
    frames has its beginning and end without the others being run, and ``active``
    frames are open at any time until the last ones. The result has frame_pos,
    rec_pos and out_pos.
    """
    order = frame_positions(df, seed, epoch)
    sizes = df.groupBy("frame_id").agg(F.count("*").alias("__n")).join(order, "frame_id")
    rec = F.row_number().over(Window.partitionBy("frame_id").orderBy(prf_hex(seed, "frame", epoch, "frame_id", id_col), id_col)) - 1
    share = (F.col("rec_pos").cast("double") + prf_unit(seed, "stride", epoch, "frame_id", id_col)) / F.col("__n")
    first = share * (F.col("frame_pos") + 1) / active
    later = (F.col("frame_pos") - active + 1) / F.lit(active) + share
    timed = df.join(sizes, "frame_id").withColumn("rec_pos", rec.cast("long")).withColumn("__time", F.when(F.col("frame_pos") < active, first).otherwise(later))
    timed = timed.withColumn("__slot", F.floor(F.col("__time") * active).cast("long"))  # between two ends: about a frame's rows
    before = running_before(timed.groupBy("__slot").agg(F.count("*").alias("__rows")), "__slot", "__rows").drop("__rows")
    within = F.row_number().over(Window.partitionBy("__slot").orderBy("__time", "frame_pos", "rec_pos")) - 1
    placed = timed.withColumn("__within", within).join(before, "__slot")
    return placed.withColumn("out_pos", (F.col("before") + F.col("__within")).cast("long")).drop("__n", "__time", "__slot", "__within", "before")


def buffer_shuffle(df: DataFrame, size: int = DEFAULT_BUFFER, seed: int = 0, epoch: int = 0, position: str = "pos", group: str | None = None) -> DataFrame:
    """A ring of ``size`` slots whose every new record evicts a random one, in closed form.

    The record at position i >= size lands in a random slot; it drives out the
    one that landed there before, which so leaves at position i - size. What
    stays in the ring at the end leaves in hashed order.
    """
    ids = [*([group] if group else []), position]
    slot = F.when(F.col(position) < size, F.col(position)).otherwise(prf_mod(seed, "buf", epoch, size, *ids))
    slots = df.withColumn("__group", F.col(group) if group else F.lit(0)).withColumn("__slot", slot)
    nxt = slots.withColumn("__next", F.lead(position).over(Window.partitionBy("__group", "__slot").orderBy(position)))
    # the rows that stay, at most ``size`` a group, are placed apart; the others carry no count
    staying = nxt.filter("__next is null").select("__group", "__slot", position, prf_hex(seed, "drain", epoch, *ids).alias("__h"))
    of_group = Window.partitionBy("__group")
    staying = staying.withColumn("__k", F.row_number().over(of_group.orderBy("__h", position)) - F.count("*").over(of_group) - 1)
    counts = slots.groupBy("__group").agg(F.count("*").alias("__n"))
    staying = staying.join(F.broadcast(counts) if group is None else counts, "__group").select("__group", "__slot", (F.col("__n") + F.col("__k")).alias("__end"))
    placed = nxt.join(staying, ["__group", "__slot"]).withColumn("out_pos", F.coalesce(F.col("__next") - size, "__end").cast("long"))
    return placed.select(*df.columns, "out_pos")


def epoch_counts(df: DataFrame) -> DataFrame:
    """epoch and how many rows it has."""
    return df.groupBy("epoch").agg(F.count("*").alias("records"))


def reservoir(df: DataFrame, size: int = DEFAULT_RESERVOIR, seed: int = 0, epoch: int = 0, position: str = "pos", group: str | None = None) -> DataFrame:
    """min(size, rows) rows, each row equally likely, in hashed order; combined before the shuffle.

    Record i >= size replaces the one in slot j, uniform in [0, i], if j < size;
    so each slot ends with the last record that drew it.
    """
    keys = [group] if group else []
    ids = [*keys, position]
    slot = F.when(F.col(position) < size, F.col(position)).otherwise(prf_mod(seed, "res", epoch, F.col(position) + 1, *ids))
    last = df.withColumn("__slot", slot).filter(F.col("__slot") < size).groupBy(*keys, "__slot").agg(F.max_by(F.struct(*df.columns), position).alias("r"))
    rows = last.select("r.*")
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return rows.withColumn("out_pos", (F.row_number().over(part.orderBy(prf_hex(seed, "resorder", epoch, *ids), position)) - 1).cast("long"))
