"""Seekable zstandard files as a Spark data source, format ``seekable_zstd``.

A file is a run of frames, each a whole zstandard frame of whole lines, and a
seek table in a skippable frame at the end. ``read_seekable`` reads tables and
frames in tasks; the data source plans one task per run of frames from the
tables, of the frames that a filter on file_id and frame_id leaves. Records are
bytes. Writing gives one such file a partition under a folder that the
cluster shares; rows come sorted with their frame_id. Files are read and written
through pyarrow's file systems, so paths may be local or those of a store.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from ..operators.errors import InputMissing, UsageError
from ..operators.frames import size_summary
from .files import STREAMED, store

#: Fixed values of the public seekable format.
TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1
FOOTER, CHECKSUM_FLAG, RESERVED_BITS = 9, 0x80, 0x7C
FRAMES_A_TASK = 64
MOST_FRAME_BYTES = (1 << 32) - 1
#: Entries of a seek table that are read first to find the frames behind one.
ENTRIES_AT_FIRST = 16


@dataclass(frozen=True)
class Frame:
    frame_id: int
    offset: int
    compressed: int
    decompressed: int
    checksum: int | None


def seek_table(frames: list[tuple[int, int, int]], checksum: bool = True) -> bytes:
    """The bytes after the last frame, from (compressed size, decompressed size, checksum) of each."""
    body = b"".join(struct.pack("<III", *f) if checksum else struct.pack("<II", *f[:2]) for f in frames)
    return struct.pack("<II", TABLE_MAGIC, len(body) + FOOTER) + body + struct.pack("<IBI", len(frames), CHECKSUM_FLAG if checksum else 0, FOOTER_MAGIC)


def _footer(file, path: str) -> tuple[int, int, int]:
    """Of an open seekable file: frames, bytes of an entry, place of the first entry."""
    size = file.size()
    if size < FOOTER + 8:
        raise UsageError(f"{path} is no seekable file")
    file.seek(size - FOOTER)
    count, flags, magic = struct.unpack("<IBI", file.read(FOOTER))
    if magic != FOOTER_MAGIC or flags & RESERVED_BITS:
        raise UsageError(f"{path} has no seek table")
    width = 12 if flags & CHECKSUM_FLAG else 8
    entries = size - FOOTER - count * width
    if entries < 8:
        raise UsageError(f"{path}: the seek table is larger than the file")
    return count, width, entries


def _frames_from(body: bytes, width: int, frame_id: int, offset: int) -> Iterator[Frame]:
    """The frames of some entries, the first of which is ``frame_id`` at ``offset``."""
    for i, entry in enumerate(struct.iter_unpack("<III" if width == 12 else "<II", body)):
        yield Frame(frame_id + i, offset, entry[0], entry[1], entry[2] if width == 12 else None)
        offset += entry[0]


def read_seek_table(path: str) -> list[Frame]:
    where, name = store(path)
    try:
        opened = where.open_input_file(name)
    except FileNotFoundError as e:
        raise InputMissing(path) from e
    with opened as file:
        count, width, entries = _footer(file, path)
        file.seek(entries - 8)
        head, length = struct.unpack("<II", file.read(8))
        if head != TABLE_MAGIC or length != count * width + FOOTER:
            raise UsageError(f"{path}: the seek table is damaged")
        out = list(_frames_from(file.read(count * width), width, 0, 0))
    if (out[-1].offset + out[-1].compressed if out else 0) != entries - 8:
        raise UsageError(f"{path}: sizes of frames and file disagree")
    return out


def frames_behind(path: str, frame: Frame) -> Iterator[Frame]:
    """The frames that follow one of a file. Their entries are read some at a time, twice as many each time, so one who stops early reads few of a long table."""
    where, name = store(path)
    with where.open_input_file(name) as file:
        count, width, entries = _footer(file, path)
        at, offset, some = frame.frame_id + 1, frame.offset + frame.compressed, ENTRIES_AT_FIRST
        while at < count:
            for last in _frames_from(file.read_at(min(some, count - at) * width, entries + at * width), width, at, offset):
                yield last
            at, offset, some = last.frame_id + 1, last.offset + last.compressed, 2 * some


def remove(path: str) -> None:
    where, name = store(path)
    where.delete_file(name)


def files_of(path: str, suffix: str = ".zst") -> list[str]:
    """The input itself, or the files of a folder that end so, by name."""
    from pyarrow import fs

    where, name = store(path)
    if where.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = where.get_file_info(fs.FileSelector(name))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.base_name.endswith(suffix))


def decompress(path: str, frame: Frame) -> bytes:
    import zstandard

    where, name = store(path)
    with where.open_input_file(name) as file:
        return zstandard.ZstdDecompressor().decompress(file.read_at(frame.compressed, frame.offset), max_output_size=max(1, frame.decompressed))


class _Frames(InputPartition):
    def __init__(self, path: str, file_id: int, frames: list[Frame]):
        super().__init__((path, file_id, frames))


def lines_of(raw: bytes) -> list[bytes]:
    """Records of some bytes; the last may lack its line feed."""
    lines = raw.split(b"\n")
    if not lines[-1]:
        lines.pop()
    return lines


#: Comparisons that are decided from the seek tables.
DECIDED = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b}


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.wanted: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in DECIDED and f.attribute in (("file_id",), ("frame_id",)):
                self.wanted.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self):
        fits = lambda **at: all(DECIDED[kind](at[name], value) for name, kind, value in self.wanted if name in at)
        out = []
        for file_id, path in enumerate(files_of(self.path)):
            frames = [f for f in read_seek_table(path) if fits(frame_id=f.frame_id)] if fits(file_id=file_id) else []
            out += [_Frames(path, file_id, frames[i : i + FRAMES_A_TASK]) for i in range(0, len(frames), FRAMES_A_TASK)]
        return out or [_Frames("", 0, [])]

    def read(self, partition):
        path, file_id, frames = partition.value
        for frame in frames:
            at = 0
            for line in lines_of(decompress(path, frame)):
                yield file_id, frame.frame_id, at, line
                at += len(line) + 1


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    frames: int


class _Writer(DataSourceWriter):
    """Files are written beside their final names; the driver renames those of the attempts that counted and removes the others."""

    def __init__(self, options):
        self.path = options["path"]
        self.level = int(options.get("level", "3"))
        self.checksum = options.get("checksum", "true") == "true"
        self.cut_bytes = int(options.get("cut_bytes", "0"))
        self.job = uuid.uuid4().hex[:12]

    def write(self, rows):
        import xxhash
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=self.level)
        where, folder = store(self.path)
        where.create_dir(folder, recursive=True)
        name = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}-{self.job}-{uuid.uuid4().hex[:8]}.zst"
        table: list[tuple[int, int, int]] = []
        held: list[bytes] = []
        size, current = 0, None
        with where.open_output_stream(f"{name}.tmp") as file:

            def close():
                raw = b"".join(held)
                if len(raw) > MOST_FRAME_BYTES:
                    raise UsageError("a frame exceeds 4 GiB")
                made = pack.compress(raw)
                file.write(made)
                table.append((len(made), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
                held.clear()

            for row in rows:
                line = bytes(row["record"] or b"") + b"\n"
                if self.cut_bytes:  # frames of so many bytes, wherever records end
                    while size + len(line) >= self.cut_bytes:
                        at = self.cut_bytes - size
                        held.append(line[:at])
                        close()
                        line, size = line[at:], 0
                    size += len(line)
                    held += [line] if line else []
                    continue
                if current is not None and row["frame_id"] != current:
                    close()
                current = row["frame_id"]
                held.append(line)
            if held:
                close()
            if table:
                file.write(seek_table(table, self.checksum))
        return _Written(name if table else None, len(table))

    def _finish(self, kept: set[str]) -> None:
        from pyarrow import fs

        where, folder = store(self.path)
        for f in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f"-{self.job}-" in f.base_name and f.base_name.endswith(".tmp"):
                final = f.path.removesuffix(".tmp")
                if final in kept:
                    where.move(f.path, final)
                else:
                    where.delete_file(f.path)

    def commit(self, messages):
        self._finish({m.file for m in messages if m and m.file})

    def abort(self, messages):
        self._finish(set())


class SeekableZstd(DataSource):
    @classmethod
    def name(cls):
        return "seekable_zstd"

    def schema(self):
        return "file_id int, frame_id int, offset_in_frame long, record binary"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SeekableZstd)


def write_seekable(df: DataFrame, out: str, level: int = 3, checksum: bool = True, counts: Observation | None = None, spread: tuple[int, int] | None = None) -> None:
    """``df`` with frame_id, pos and record as seekable files under ``out``; frames stay whole. ``counts`` gets the number of records written.

    ``spread``: how many files to write, and a number of frames that there are at most; then ``df`` isn't read to sample its frames.
    """
    register(df.sparkSession)
    dealt = df.repartitionById(spread[0], F.expr(f"CAST(CAST(frame_id AS BIGINT) * {spread[0]} div {spread[1]} AS INT)")) if spread else df.repartitionByRange("frame_id")
    dealt = dealt.sortWithinPartitions("frame_id", "pos").select("frame_id", "record")
    shaped = dealt.select(F.lit(0).alias("file_id"), F.col("frame_id").cast("int"), F.lit(0).cast("long").alias("offset_in_frame"), F.col("record").cast("binary").alias("record"))
    if counts is not None:
        shaped = shaped.observe(counts, F.count(F.lit(1)).alias("records"))
    shaped.write.format("seekable_zstd").option("path", out).option("level", str(level)).option("checksum", str(checksum).lower()).mode("append").save()


def write_cut(df: DataFrame, out: str, frame_size: int, level: int = 3, checksum: bool = True, counts: Observation | None = None, in_order: bool = False) -> None:
    """``df`` with pos and record as seekable files whose frames have exactly ``frame_size`` bytes each, but for a file's last.

    Files hold whole records; frames don't, so such files have no chunks to shuffle: they are read in order, by
    position, or framed anew. ``in_order``: rows already lie in order over the partitions; then nothing is shuffled.
    """
    if frame_size < 1:
        raise UsageError("a frame has a byte at least")
    register(df.sparkSession)
    dealt = df if in_order else df.repartitionByRange("pos").sortWithinPartitions("pos")
    shaped = dealt.select(F.lit(0).alias("file_id"), F.lit(0).alias("frame_id"), F.lit(0).cast("long").alias("offset_in_frame"), F.col("record").cast("binary").alias("record"))
    if counts is not None:
        shaped = shaped.observe(counts, F.count(F.lit(1)).alias("records"))
    shaped.write.format("seekable_zstd").option("path", out).option("level", str(level)).option("checksum", str(checksum).lower()).option("cut_bytes", str(frame_size)).mode("append").save()


def read_seekable(spark: SparkSession, path: str, frames: list[int] | None = None) -> DataFrame:
    """file_id, frame_id, offset_in_frame and record, in bytes; tables and frames are read in tasks, and only the ``frames`` asked for."""
    import numpy as np
    import pyarrow as pa

    entries = frame_entries(spark, path)
    if frames is not None:
        entries = entries.filter(F.col("frame_id").isin(frames))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lines = lines_of(decompress(r["path"], Frame(r["frame_id"], r["offset"], r["compressed"], r["decompressed"], r["checksum"])))
                sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)) + 1
                whole = [pa.array(np.full(len(lines), r[c], dtype=np.int32)) for c in ("file_id", "frame_id")]
                yield pa.RecordBatch.from_arrays([*whole, pa.array(np.cumsum(sizes) - sizes), pa.array(lines, pa.binary())], names=["file_id", "frame_id", "offset_in_frame", "record"])

    return entries.repartition("path", "frame_id").mapInArrow(run, "file_id int, frame_id int, offset_in_frame long, record binary")


def frame_entries(spark: SparkSession, path: str) -> DataFrame:
    """What the seek tables say, without reading frames. Tables are read in tasks, a file each."""
    import pyarrow as pa

    files = files_of(path)
    for f in files:
        if not STREAMED.match(f):
            raise UsageError(f"{f}: seekable files are read from a mounted folder or an object store")

    def run(batches):
        for batch in batches:
            for file_id, file in zip(*(c.to_pylist() for c in batch.columns)):
                frames = read_seek_table(file)
                columns = [[f.frame_id for f in frames], [f.offset for f in frames], [f.compressed for f in frames], [f.decompressed for f in frames], [f.checksum for f in frames]]
                yield pa.RecordBatch.from_arrays([pa.array([file_id] * len(frames), pa.int32()), pa.array([file] * len(frames), pa.string()), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["file_id", "path", "frame_id", "offset", "compressed", "decompressed", "checksum"])

    read_seek_table(files[0]) if len(files) == 1 else None  # says what is wrong with a single file before any task
    listing = spark.createDataFrame(list(enumerate(files)), "file_id int, path string").repartition(max(1, min(len(files), 10_000)), "path")
    return listing.mapInArrow(run, "file_id int, path string, frame_id int, offset long, compressed long, decompressed long, checksum long").withColumn("file", F.regexp_extract("path", "[^/]+$", 0))


def info(spark: SparkSession, path: str) -> DataFrame:
    """One row: frames, payload bytes, their ratio, size of the files, and sizes of frames."""
    about = size_summary(frame_entries(spark, path), "decompressed", "compressed")
    sizes = [where.get_file_info(name).size for where, name in map(store, files_of(path))]
    return about.withColumn("ratio", F.col("decompressed") / F.col("compressed")).withColumn("file_bytes", F.lit(sum(sizes)).cast("long"))


def frame_problem(raw: bytes, size: int, checksum: int | None) -> str | None:
    """How an unpacked frame differs from its entry."""
    import xxhash

    if len(raw) != size:
        return f"{len(raw)} bytes, not {size}"
    return "checksum" if checksum is not None and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum else None


def verify_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames that don't decompress to the size and checksum of their entry: file, frame_id and problem."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bad = []
            for r in batch.to_pylist():
                frame = Frame(r["frame_id"], r["offset"], r["compressed"], r["decompressed"], r["checksum"])
                try:
                    problem = frame_problem(decompress(r["path"], frame), frame.decompressed, frame.checksum)
                except Exception as e:
                    problem = f"unreadable: {e}"
                if problem:
                    bad.append((r["file"], frame.frame_id, problem))
            yield pa.RecordBatch.from_pydict({"file": pa.array([b[0] for b in bad], pa.string()), "frame_id": pa.array([b[1] for b in bad], pa.int32()), "problem": pa.array([b[2] for b in bad], pa.string())})

    return frame_entries(spark, path).repartition("path", "frame_id").mapInArrow(run, "file string, frame_id int, problem string")
