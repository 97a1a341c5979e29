"""Reading tables and cutting lineage in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local session may go without: it gets a folder of its own."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        where = tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of ours, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a reliable checkpoint, which outlives lost executors."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Tables of so many short rows are broadcast: a few megabytes.
BROADCAST_ROWS = 1 << 15


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, one row a ``key``, without bringing a frequent key's rows together.

    ``count`` names a column of ``keyed``: how many of ``rows`` have the key. At
    most BROADCAST_ROWS keys have more than that share of all rows; those are
    broadcast, so only keys with fewer rows each are joined by a shuffle.
    ``total`` is the sum of the counts, if known. ``keyed`` is read several
    times: it should come from a checkpoint.
    """
    if total is None:
        total = keyed.agg(F.sum(count)).first()[0] or 0
    many = max(1024, total // BROADCAST_ROWS)
    frequent = keyed.filter(F.col(count) > many)
    often = rows.join(F.broadcast(frequent), key)
    seldom = rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(keyed.filter(F.col(count) <= many), key)
    return often.unionByName(seldom)


#: Bits of a filter; 16 MB.
MOST_BITS = 1 << 27
WORD_BITS = 1 << 15


def maybe_among(rows: DataFrame, column: str, ids: DataFrame, n: int) -> DataFrame:
    """Rows whose ``column`` is among the ``n`` of ``ids``, and a few others: those whose hash meets one of them in a bitmap.

    The bitmap has 16 bits an id, up to MOST_BITS, in rows of 4 KB, and is
    broadcast; beyond that it lets more rows through, but never fewer.
    """
    bits = min(MOST_BITS, max(WORD_BITS, 1 << (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marked = ids.select(place(column).alias("p")).select(F.expr(f"p div {WORD_BITS}").alias("__word"), (F.col("p") % WORD_BITS).alias("bit"))
    maps = marked.groupBy("__word").agg(F.bitmap_construct_agg("bit").alias("__map"))
    word, bit = F.floor(place(rows[column]) / WORD_BITS), place(rows[column]) % WORD_BITS
    byte = F.conv(F.hex(F.substring(F.col("__map"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0
    return rows.join(F.broadcast(maps), (word == F.col("__word")) & hit, "left_semi")


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, behind as many underscores as keep it apart from the names that are taken."""
    taken = [t.lower() for t in taken]
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def as_struct(columns: list[str]):
    """Columns, whatever their names, as one."""
    return F.struct(*(F.col(f"`{c}`") for c in columns))


def crc32_remainder(column: str, modulus: int):
    """``crc32(text of column) mod modulus``, null as the empty string."""
    return F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")) % modulus


def in_slices(batches, rows: int = 256):
    """Batches of at most ``rows`` rows, so that what is made from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_byte_slices(batches, column: str, most: int = 16 << 20):
    """Batches whose texts in ``column`` have at most ``most`` bytes, or are one text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
