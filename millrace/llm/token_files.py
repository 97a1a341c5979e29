"""Token ids in Parquet: one list column beside narrow metadata columns.

Files hold ascending ids of documents: the texts are dealt by range, encoded
and written in that order. The list column is dictionary-encoded (a vocabulary
fits one dictionary page), the metadata columns delta-encoded; row groups and
pages are small enough that the page indexes let a reader skip to some
documents, and the metadata can be read without touching the ids.

Null texts are empty ones; very long texts are encoded whole, and a long one by
itself: texts of at most 16 MB together are in memory encoded.
Null ids come first; rows with one id are ordered by their text's hash, and
repeated rows are kept. Columns of other names are not written, whatever they
are called. An empty table gives an empty dataset.
"""

from __future__ import annotations

from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import STREAMED, store
from .common import BROADCAST_ROWS, cut, in_byte_slices
from .tokens import crc32_of, encode_column, id_lists

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000


def write_token_files(df: DataFrame, out: str, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Columns ``id_col``, n_tokens and ids of every row of ``df``, in ascending order of the id over the files."""

    def run(batches):
        for batch in in_byte_slices(batches, "text"):
            ids, offsets = encode_column(batch.column("text"), path, end_id)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), pa.array(np.diff(offsets)), id_lists(ids, offsets)], names=["id", "tie", "n_tokens", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    dealt = (
        df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
        .repartitionByRange("id", "tie")
        .sortWithinPartitions("id", "tie")
    )
    encoded = dealt.mapInArrow(run, f"id {kind}, tie long, n_tokens long, ids array<int>")
    (
        encoded.select(F.col("id").alias(id_col), "tie", "n_tokens", "ids")
        .write.option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", 1)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "true")
        .option(f"parquet.enable.dictionary#{id_col}", "false")
        .option("parquet.enable.dictionary#tie", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(out)
    )


def read_token_files(spark: SparkSession, out: str, id_col: str = "doc_id", first=None, last=None, with_ids: bool = True) -> DataFrame:
    """Rows of a dataset, or those whose id lies in [first, last]; without ids only metadata pages are read."""
    rows = spark.read.parquet(out)
    if first is not None:
        rows = rows.filter(F.col(id_col) >= first)
    if last is not None:
        rows = rows.filter(F.col(id_col) <= last)
    return rows if with_ids else rows.drop("ids")


#: Rows of a file that are in memory at a time, and types of ids that files and Spark hold alike.
ROWS_READ = 4_096
PLAIN_IDS = ("long", "integer", "short", "byte", "string")


def _in_tasks(before: DataFrame, n: int, id_col: str, kind: str) -> DataFrame:
    """id, start, n_tokens and ids_crc32 of the documents in ``n`` files (file, before), a file a task."""

    def run(batches):
        for path, start in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))):
            where, name = store(unquote(path))
            with where.open_input_file(name) as file:
                for part in pq.ParquetFile(file).iter_batches(ROWS_READ, columns=[id_col, "ids"]):
                    lists = part.column("ids")
                    offsets = lists.offsets.to_numpy()
                    crc = pa.array(crc32_of(lists.values.to_numpy(zero_copy_only=False), offsets[:-1], offsets[1:]), pa.int64())
                    sizes = np.diff(offsets).astype(np.int64)
                    starts = start + np.cumsum(sizes) - sizes
                    start += int(sizes.sum())
                    yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(starts), pa.array(sizes), crc], names=["id", "start", "n_tokens", "ids_crc32"])

    return before.select("file", "before").repartition(max(1, n), "file").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def _by_spark(spark: SparkSession, out: str, before: DataFrame, n: int, id_col: str, kind: str) -> DataFrame:
    """The same where only Spark reads the store."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False)
            crc = pa.array(crc32_of(ids, offsets[:-1], offsets[1:]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("at"), batch.column("id"), pa.array(np.diff(offsets).astype(np.int64)), crc], names=["file", "at", "id", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(out).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), F.col(id_col).alias("id"), "ids")
    documents = rows.mapInArrow(run, f"file string, at long, id {kind}, n_tokens long, ids_crc32 long")
    running = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    placed = documents.withColumn("within", running - F.col("n_tokens")).join(F.broadcast(before) if n <= BROADCAST_ROWS else before, "file")
    return placed.select("id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_index(spark: SparkSession, out: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of a dataset: id, start (ids of all documents before it), n_tokens, ids_crc32.

    What lies before a file comes from the files' totals in the order of their
    ids and ties: a window over one row a file, however many documents. Running
    sums are taken on from there within each file, which is one bounded range
    of ids, by the task that reads it: documents are neither joined nor moved.
    """
    dataset = spark.read.parquet(out)
    kind = dataset.schema[id_col].dataType
    totals = dataset.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.sum("n_tokens").alias("total"), F.min(id_col).alias("low"), F.max(id_col).alias("high"), F.max(F.col(id_col).isNull().cast("int")).alias("nulls"), F.min("tie").alias("tie"))
    # of files between the same ids, one with nulls is the first, and the others hold that id alone
    order = Window.orderBy("low", "high", F.desc("nulls"), "tie")
    before = cut(totals.select("file", (F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before")))
    n, streamed = before.agg(F.count("*"), F.count_if(F.col("file").rlike(f"^{STREAMED.pattern}"))).first()
    alike = kind.typeName() in PLAIN_IDS and n == streamed
    found = _in_tasks(before, n, id_col, kind.simpleString()) if alike else _by_spark(spark, out, before, n, id_col, kind.simpleString())
    return found.withColumnRenamed("id", id_col)
