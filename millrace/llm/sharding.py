"""Shards of bounded bytes by extendible hashing, in DataFrame operations only.

A row's key is hashed to 60 bits. The directory is a binary trie over the
leading bits: a bucket whose rows exceed the byte limit splits on its next bit,
the others stay. All splits of a round come from one aggregation: byte sums of
the buckets at the round's deepest bit, added up to every shorter prefix; a
bucket's depth is one more than the deepest prefix above it that is too large.
Only buckets that are still too large go into the next round. A bucket that no
bit can split, as it holds one key, is divided into pages of the limit by the
rows' running bytes; a row larger than the limit is a page of its own.

Null texts have 0 bytes; of a very long text only its length is kept until its
shard is written. A row with a null id is keyed by its text. Repeated rows share
a bucket, and where it is paged it doesn't matter which of them gets which page.
An empty table gives no rows. Columns of other names, whatever they are called,
are left out of the assignment and written unchanged with the shards.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_struct, cut, free_name, join_by_key

BITS = 60
#: Bits that one round looks at beyond the depth that even hashing would need.
MORE_BITS = 4


def hashed(id_col: str, text_col: str):
    """60 leading bits of the md5 of the key."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def prefix(h, depth):
    """The leading ``depth`` bits of a hash."""
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def _round(active: DataFrame, base: int, bits: int, limit: int) -> DataFrame:
    """Buckets of rows that share their first ``base`` bits, after looking at ``bits`` more.

    Per cell (prefix of base + bits bits): its rows, its depth in the directory, the bucket's bytes, and whether it is still too large.
    """
    depth = base + bits
    cells = active.groupBy(prefix(F.col("h"), F.lit(depth)).alias("cell")).agg(
        F.count("*").alias("rows"), F.sum("n_bytes").alias("bytes"), (F.min("h") != F.max("h")).alias("splits"), F.min("h").alias("low"), F.max("h").alias("high")
    )
    above = cells.select("cell", "bytes", "low", "high", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("d"))
    above = above.withColumn("node", F.call_function("shiftright", F.col("cell"), (F.lit(depth) - F.col("d")).cast("int")))
    sizes = above.groupBy("d", "node").agg(F.sum("bytes").alias("total"), (F.min("low") != F.max("high")).alias("several"))
    leaf = (
        above.join(sizes, ["d", "node"])
        .groupBy("cell")
        .agg(F.max(F.when((F.col("total") > limit) & F.col("several"), F.col("d"))).alias("full"), F.collect_list(F.struct("d", "total")).alias("path"))
        .withColumn("depth", F.least(F.coalesce(F.col("full") + 1, F.lit(base)), F.lit(depth)))
        .withColumn("total", F.expr("filter(path, x -> x.d = depth)[0].total"))
    )
    return leaf.join(cells.select("cell", "rows", "splits"), "cell").select("cell", "rows", "depth", "total", ((F.col("total") > limit) & F.col("splits")).alias("open"))


def assign_shards(df: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, depth and bucket (the shard's bits, as a number), page, shard_bytes, oversized.

    ``oversized`` marks shards above the limit: those of one row that alone is larger.
    """
    return _placed(df.select(F.col(id_col).alias("kept"), *_measured(id_col, text_col)), limit).withColumnRenamed("kept", id_col)


def _measured(id_col: str, text_col: str) -> tuple:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), hashed(id_col, text_col).alias("h")


def _placed(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (kept, n_bytes, h) with their shards."""
    rows = cut(rows)
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(1, min(BITS, math.ceil(math.log2(max(1, total) / limit + 1)) + MORE_BITS))
    done = []
    active, base = rows, 0
    while True:
        found = cut(_round(active, base, bits, limit))
        n_open = found.agg(F.sum(F.col("open").cast("int"))).first()[0]
        placed = join_by_key(active.withColumn("cell", prefix(F.col("h"), F.lit(base + bits))), found, "cell", "rows")
        done.append(placed.filter(~F.col("open") | (F.lit(base + bits) >= BITS)).select("kept", "n_bytes", "h", "depth", "total"))
        base += bits
        if not n_open or base >= BITS:
            break
        active = placed.filter("open").select("kept", "n_bytes", "h")
        bits = min(BITS - base, 2 * MORE_BITS)
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.unionByName(more)
    leaves = leaves.withColumn("bucket", prefix(F.col("h"), F.col("depth")))
    fitting = leaves.filter(F.col("total") <= limit).select("kept", "n_bytes", "depth", "bucket", F.lit(0).cast("long").alias("page"), F.col("total").alias("shard_bytes"))
    return fitting.unionByName(_pages(leaves.filter(F.col("total") > limit), limit)).withColumn("oversized", F.col("shard_bytes") > limit)


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of unsplittable buckets. Rows above half the limit are pages alone; the others fill pages of half the limit and a row.

    Their running bytes are taken in two levels, partition by partition, so that one key's rows needn't meet in a task.
    """
    rows = cut(rows.select("kept", "n_bytes", "depth", "bucket")).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    small = rows.filter(F.col("n_bytes") * 2 <= limit)
    large = rows.filter(F.col("n_bytes") * 2 > limit)
    per_part = small.groupBy("depth", "bucket", "part").agg(F.sum("n_bytes").alias("sum"))
    before = per_part.withColumn("before", F.sum("sum").over(Window.partitionBy("depth", "bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum")).drop("sum")
    within = F.sum("n_bytes").over(Window.partitionBy("depth", "bucket", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_bytes")
    paged = small.withColumn("within", within).join(before, ["depth", "bucket", "part"])
    half = max(1, limit // 2)
    paged = paged.withColumn("page", F.floor((F.col("before") + F.col("within")) / half).cast("long"))
    sums = paged.groupBy("depth", "bucket", "page").agg(F.sum("n_bytes").alias("shard_bytes"))
    columns = ["kept", "n_bytes", "depth", "bucket", "page", "shard_bytes"]
    alone = large.select("kept", "n_bytes", "depth", "bucket", (-1 - F.col("at")).alias("page"), F.col("n_bytes").alias("shard_bytes"))
    return paged.join(sums, ["depth", "bucket", "page"]).select(columns).unionByName(alone.select(columns))


def write_shards(df: DataFrame, out: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Every row of ``df`` as it is under ``out``, one folder a shard. Returns the name of the column that Spark reads from the
    folders: shard, behind as many underscores as keep it apart from the columns of ``df``."""
    name = free_name("shard", df.columns)
    placed = _placed(df.select(as_struct(df.columns).alias("kept"), *_measured(id_col, text_col)), limit)
    shards = placed.select("kept.*", F.concat_ws("-", "depth", "bucket", "page").alias(name))
    shards.repartition(name).write.partitionBy(name).parquet(out)
    return name
