"""JSONL in and out: codecs found by content, records as the bytes they are, rows as JSON objects."""

from __future__ import annotations

import io
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.errors import ModeUnavailable, UsageError
from ..operators.shared import shared_path
from .files import STREAMED, detect, first_bytes, listed, store, unpacked

SUFFIX = {"gzip": (".gz",), "zstd": (".zst",), "bzip2": (".bz2",)}


def _heads(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Path and format of every input file, in the order of paths; 16 bytes of each are read."""
    files = [(r["path"], r["length"]) for r in listed(spark, path).orderBy("path").collect()]  # one row a file
    return [(file, detect(head)) for (file, _), head in zip(files, first_bytes(spark, files))]


LINES_A_BATCH, BYTES_A_BATCH = 4_096, 4 << 20
LINES = "file string, row long, record binary"


def _line_batches(file: str, reader):
    """Batches of (file, row, record) from a binary stream, some lines at a time."""
    lines, size, at = [], 0, 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(lines)), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.binary())], names=["file", "row", "record"])

    for line in reader:
        lines.append(line.removesuffix(b"\n"))
        size += len(line)
        if len(lines) >= LINES_A_BATCH or size >= BYTES_A_BATCH:
            yield batch()
            at += len(lines)
            lines, size = [], 0
    if lines:
        yield batch()


def _streamed(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """Lines of files that Spark's text reader can't unpack: a file a task, decompressed and split as it is read."""
    fit = [f for f in files if STREAMED.match(f[0])]
    other = [f for f in files if not STREAMED.match(f[0])]

    def from_store(batches):
        for b in batches:
            for file, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                where, name = store(file)
                with where.open_input_file(name) as raw, unpacked(kind, raw) as reader:
                    yield from _line_batches(file, reader)

    def from_content(batches):
        for b in batches:
            for file, kind, raw in zip(*(c.to_pylist() for c in b.columns)):
                with unpacked(kind, io.BytesIO(raw)) as reader:
                    yield from _line_batches(file, reader)

    out = spark.createDataFrame(fit, "path string, kind string").repartition(max(1, len(fit)), "path").mapInArrow(from_store, LINES)
    if other:  # stores that only Spark reads hand on whole files, of at most 2 GiB
        kinds = spark.createDataFrame(other, "path string, kind string")
        content = spark.read.format("binaryFile").load([f for f, _ in other]).select("path", "content")
        out = out.unionByName(content.join(F.broadcast(kinds), "path").select("path", "kind", "content").mapInArrow(from_content, LINES))
    return out


def read_records(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """file, row (order within the file) and record (bytes) of every line.

    Plain files, and compressed ones whose names Spark knows, are read as text,
    split where Spark can. xz files and those with other names than their
    content are streamed, one file a task. lz4 is refused.
    """
    by_text, by_content = [], []
    for file, found in _heads(spark, path):
        found = kind or found
        if found == "lz4":
            raise ModeUnavailable("lz4 input is not supported")
        if found == "parquet":
            raise UsageError(f"{file} is a Parquet file: its rows are records, its bytes aren't")
        suffix = os.path.splitext(file)[1]
        known = any(suffix in s for s in SUFFIX.values())
        (by_text if (found == "plain" and not known) or suffix in SUFFIX.get(found, ()) else by_content).append((file, found))
    out = None
    if by_text:
        lines = spark.read.option("lineSep", "\n").text([f for f, _ in by_text])
        out = lines.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("record"))
    if by_content:
        more = _streamed(spark, by_content)
        out = more if out is None else out.unionByName(more)
    return spark.createDataFrame([], LINES) if out is None else out  # Spark lists no empty files


def spool(spark: SparkSession, lines) -> str:
    """A file in the shared folder with the lines of a byte stream, such as standard input, as they are.

    A stream has one reader; what it wrote is then read by ranges as any other file.
    """
    out = shared_path(spark, "spool")
    where, name = store(out)
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(name) as file:
        for line in lines:
            file.write(line)
    return out


def _plain(c: Column, kind: T.DataType, strict: bool) -> Column | None:
    """A column as JSON wants it; None where the value has no form in strict mode."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        wide = c.cast("double")
        return F.when(F.isnan(wide) | wide.isin(float("inf"), float("-inf")), F.lit(None).cast("double")).otherwise(wide)
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _plain(x, kind.elementType, strict) if _plain(x, kind.elementType, strict) is not None else F.lit(None).cast("string"))
    if strict and isinstance(kind, (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StructType, T.MapType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return None
    return c


def to_json_record(df: DataFrame, strict: bool = False) -> Column:
    """Each row as a JSON object with sorted keys; nulls are kept, non-finite numbers null, binary lower-case hex.

    ``strict``: dates, decimals, intervals, structs and maps are null.
    """
    fields = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        made = _plain(F.col(f"`{f.name}`"), f.dataType, strict)
        fields.append((F.lit(None).cast("string") if made is None else made).alias(f.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def write_records(df: DataFrame, out: str, order: str = "out_pos", record: str = "record", compression: str | None = None) -> None:
    """Lines in ``order`` over the part files, each ending in a line feed."""
    dealt = df.repartitionByRange(order).sortWithinPartitions(order).select(F.col(record).cast("string").alias("value"))  # text is written byte for byte
    writer = dealt.write.option("lineSep", "\n")
    (writer.option("compression", compression) if compression else writer).text(out)
