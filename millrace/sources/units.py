"""Inputs as tables of work: byte ranges of plain files, frames of seekable ones, blocks of xz files, others whole.

A unit is what one task reads at a stretch, a row of file, begin and finish. Units
are planned, counted, numbered, permuted and chosen as a DataFrame of a row a
unit; texts are only read, by the units that are left, and never sorted,
shuffled or checkpointed to find out where they stand. Records are bytes without
their line feed, as they are in the file.

A record belongs to the range in which it begins: a range passes over the line
that is open at its beginning and reads its last one to its end. What a range
needs to know for positions is how many line feeds end before its last byte, so
counting reads bytes and makes no records. Blocks of xz files are cut anywhere as
well: what begins in one is known once it is known how the one before ends, and
the line that is open at its end is read on in the next. Frames mostly hold whole
records; those of a file that are cut inside records are found by counting, and
then read like blocks. The last line of a file is a record, with a line feed or
without.

Files are read through pyarrow's file systems, in tasks, first bytes and seek
tables included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prf import VERSION, prf_hex
from ..functions.records import json_problem_of
from ..operators.errors import ModeUnavailable, UsageError
from ..operators.records import of_rank, with_position
from ..operators.shared import cut, running_before
from ..operators.shuffle import place_by_hash, sample
from . import xz
from .files import STREAMED, detect, listed, store, unpacked
from .seekable import Frame, decompress, frames_behind, lines_of, frame_problem, read_seek_table

RANGE_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20
#: Bytes that a task reads, and files whose first bytes a task looks at.
TASK_BYTES, FILES_A_TASK = 128 << 20, 64
HEAD_BYTES = 16
UNIT = "file_id int, file string, kind string, part long, begin long, finish long, size long, checksum long"
NAMES = [x.split()[0] for x in UNIT.split(", ")]
#: Compressed formats that only be read from their beginning.
WHOLE = ("gzip", "zstd", "bzip2", "xz", "xz-block", "cut-frame")
#: Units that may begin and end inside a record.
BLOCKS = ("xz-block", "cut-frame")


def streamable(spark: SparkSession, path: str) -> bool:
    """Whether tasks can read the files of an input by themselves."""
    some = listed(spark, path).select("path").first()
    return some is None or bool(STREAMED.match(some["path"]))


def files_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_id (the input's number), path, length and at (microseconds of the last change) of all files."""
    files = None
    for i, path in enumerate(paths):
        own = listed(spark, path).select(F.lit(i).alias("file_id"), "path", "length", F.unix_micros("modificationTime").alias("at"))
        files = own if files is None else files.unionByName(own)
    return files


def plan(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES, kind: str | None = None) -> DataFrame:
    """The units of all inputs in order: see UNIT; ``part`` numbers the units of a file. ``kind`` is taken for what the files say."""
    return plan_files(files_of(spark, paths), range_bytes, kind)


def plan_files(files: DataFrame, range_bytes: int = RANGE_BYTES, kind: str | None = None) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for file_id, file, length in zip(*(c.to_pylist() for c in batch.columns)):
                where, name = store(file)
                with where.open_input_file(name) as f:
                    found = kind or detect(f.read(min(HEAD_BYTES, length)))
                frames = None
                if found == "zstd":
                    try:
                        frames = read_seek_table(file)
                    except UsageError:
                        pass
                if frames is not None:
                    rows += [(file_id, file, "seekable", f.frame_id, f.offset, f.offset + f.compressed, f.decompressed, f.checksum) for f in frames]
                elif found == "xz" and (blocks := _xz_blocks(file)):
                    rows += [(file_id, file, "xz-block", k, b.offset, b.offset + b.packed, b.size, b.padding << 16 | b.flags) for k, b in enumerate(blocks)]
                elif found == "plain":
                    rows += [(file_id, file, "plain", k, at, min(length, at + range_bytes), length, None) for k, at in enumerate(range(0, length, range_bytes))]
                else:
                    rows.append((file_id, file, found, 0, 0, length, length, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, (pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5))], names=NAMES)

    files = files.select("file_id", "path", "length")
    n = files.count()
    out = cut(files.repartition(max(1, -(-n // FILES_A_TASK)), "path").mapInArrow(run, UNIT))
    refused = out.filter(F.col("kind").isin("lz4", "parquet")).select("file", "kind").first()
    if refused and refused["kind"] == "lz4":
        raise ModeUnavailable(f"{refused['file']}: lz4 input is not supported")
    if refused:
        raise UsageError(f"{refused['file']} is a Parquet file: its rows are records, its bytes aren't")
    return out


def _xz_blocks(file: str) -> list[xz.Block]:
    """Blocks of a file that has several; a file of one, or with a damaged end, is read from its beginning."""
    where, name = store(file)
    with where.open_input_file(name) as f:
        try:
            blocks = xz.read_blocks(f, f.size())
        except (ValueError, IndexError, OSError):
            return []
    return blocks if len(blocks) > 1 and all(b.size for b in blocks) else []


def in_tasks(units: DataFrame, order: str | None = None) -> DataFrame:
    """Units dealt so that a task reads about TASK_BYTES; in ascending ``order`` over the tasks, if given, else file by file in each."""
    n, total = units.agg(F.count("*"), F.coalesce(F.sum(F.col("finish") - F.col("begin")), F.lit(0))).first()
    tasks = max(1, min(n, -(-total // TASK_BYTES), 1 << 20), min(n, units.sparkSession.sparkContext.defaultParallelism))
    return units.repartitionByRange(tasks, order).sortWithinPartitions(order) if order else units.repartition(tasks, "file", "part").sortWithinPartitions("file", "part")


def _range_pieces(unit: dict) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of some whole lines at a time, those that begin in a range; the file's last may lack its end."""
    where, name = store(unit["file"])
    with where.open_input_file(name) as f:
        at = unit["begin"]
        while at and at < unit["finish"]:  # past the line that is open at the beginning
            block = f.read_at(BLOCK_BYTES, at - 1)
            k = block.find(b"\n")
            at = at + k if k >= 0 else at + len(block)
            if k >= 0 or not block:
                break
        if at >= unit["finish"]:
            return
        held, first = bytearray(), at
        while block := f.read_at(BLOCK_BYTES, at):
            last = at + len(block) >= unit["finish"]
            k = block.find(b"\n", max(0, unit["finish"] - 1 - at)) if last else block.rfind(b"\n")
            held += block[: k + 1] if k >= 0 else block
            if k >= 0:
                yield first, bytes(held)
                if last:
                    return
                first, held = at + k + 1, bytearray(block[k + 1 :])
            at += len(block)
        if held:
            yield first, bytes(held)


def _whole_pieces(unit: dict) -> Iterator[tuple[int, bytes]]:
    where, name = store(unit["file"])
    held, first = bytearray(), 0
    with where.open_input_file(name) as raw, unpacked(unit["kind"], raw) as f:
        while block := f.read(BLOCK_BYTES):
            k = block.rfind(b"\n")
            if k < 0:
                held += block
                continue
            yield first, bytes(held + block[: k + 1])
            first, held = first + len(held) + k + 1, bytearray(block[k + 1 :])
    if held:
        yield first, bytes(held)


def _block_of(unit: dict) -> xz.Block:
    return xz.Block(unit["begin"], unit["finish"] - unit["begin"], unit["checksum"] >> 16, unit["size"], unit["checksum"] & 0xFFFF)


def _frame_of(unit: dict) -> Frame:
    return Frame(unit["part"], unit["begin"], unit["finish"] - unit["begin"], unit["size"], unit["checksum"])


@lru_cache(maxsize=1)
def _kept_blocks(file: str, size: int, at: int) -> np.ndarray:
    """The blocks of an xz file as it is, a row each; a task that reads a file block by block goes through its indexes once."""
    where, name = store(file)
    with where.open_input_file(name) as f:
        return np.array(xz.read_blocks(f, size), dtype=np.int64).reshape(-1, len(xz.Block._fields))


def _blocks_behind(unit: dict) -> Iterator[xz.Block]:
    where, name = store(unit["file"])
    about = where.get_file_info(name)
    blocks = _kept_blocks(unit["file"], about.size, about.mtime_ns)
    return (xz.Block(*blocks[k].tolist()) for k in range(unit["part"] + 1, len(blocks)))


def _unpacked(unit: dict, following: bool = False) -> Iterator[bytes]:
    """What a block or frame unpacks to, some at a time, or what all ``following`` ones of its file do."""
    if unit["kind"] == "cut-frame":
        for frame in frames_behind(unit["file"], _frame_of(unit)) if following else [_frame_of(unit)]:
            yield decompress(unit["file"], frame)
        return
    where, name = store(unit["file"])
    with where.open_input_file(name) as f:
        for block in _blocks_behind(unit) if following else [_block_of(unit)]:
            yield from xz.unpack(f, block)


def _block_pieces(unit: dict) -> Iterator[tuple[int, bytes]]:
    """Lines that begin in a block or cut frame; ``entered`` says whether its first byte begins one."""
    held, first, skipping = bytearray(), 0, not unit["entered"]
    for some in _unpacked(unit):
        held += some
        if skipping:
            k = held.find(b"\n")
            if k < 0:
                first, held = first + len(held), bytearray()
                continue
            first, held, skipping = first + k + 1, held[k + 1 :], False
        k = held.rfind(b"\n")
        if k >= 0 and len(held) >= BLOCK_BYTES:
            yield first, bytes(held[: k + 1])
            first, held = first + k + 1, held[k + 1 :]
    if held and not held.endswith(b"\n"):  # the last line goes on in the next ones
        for some in _unpacked(unit, following=True):
            k = some.find(b"\n")
            held += some[: k + 1] if k >= 0 else some
            if k >= 0:
                break
    if held:
        yield first, bytes(held)


def pieces(unit: dict) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of a unit's lines, some at a time; offsets count in the unpacked file, or in the frame."""
    if unit["kind"] == "plain":
        return _range_pieces(unit)
    if unit["kind"] in BLOCKS:
        return _block_pieces(unit)
    if unit["kind"] != "seekable":
        return _whole_pieces(unit)
    raw = decompress(unit["file"], _frame_of(unit))
    return iter([(0, raw)] if raw else [])


def _count(unit: dict) -> tuple[int, int, bool]:
    """Records, bytes, and whether the last line has no end. Of a block: its line feeds, bytes, and whether it ends without one."""
    where, name = store(unit["file"])
    if unit["kind"] in BLOCKS:
        records = size = 0
        last = b"\n"
        for raw in _unpacked(unit):
            records, size, last = records + raw.count(b"\n"), size + len(raw), raw[-1:]
        return records, size, last != b"\n"
    if unit["kind"] != "plain":
        records = size = 0
        last = b"\n"
        for _, raw in pieces(unit):
            size += len(raw)
            records += raw.count(b"\n") + (not raw.endswith(b"\n"))
            last = raw[-1:]
        return records, size, last != b"\n"
    records, at = int(unit["begin"] == 0), max(0, unit["begin"] - 1)
    with where.open_input_file(name) as f:
        while at < unit["finish"] - 1:
            block = f.read_at(min(BLOCK_BYTES, unit["finish"] - 1 - at), at)
            records += block.count(b"\n")
            at += len(block)
        return records, unit["finish"] - unit["begin"], unit["finish"] == unit["size"] and f.read_at(1, unit["size"] - 1) != b"\n"


def counted(units: DataFrame, meter: Accumulator | None = None) -> DataFrame:
    """``units`` with records, bytes (unpacked) and partial, whether the last line has no end. Texts are read but not handed on."""
    kept = [c for c in units.columns if c not in ("records", "bytes", "partial", "entered")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.select(*kept).schema.fields)

    def run(batches):
        for batch in batches:
            found = []
            for unit in batch.to_pylist():
                found.append(_count(unit))
                if meter is not None:
                    meter.add(1)
            columns = [pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 3, (pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "records", "bytes", "partial"])

    found = cut(in_tasks(units.select(*kept)).mapInArrow(run, f"{kinds}, records long, bytes long, partial boolean"))
    return found.withColumn("entered", F.lit(True)) if found.filter(F.col("kind").isin(*BLOCKS)).isEmpty() else _entered(found)


def _entered(units: DataFrame) -> DataFrame:
    """Counted units of which some are blocks: with ``entered``, and counts of the records that begin in a block, by how the one before ends."""
    before = units.filter(F.col("kind").isin(*BLOCKS)).select("file_id", "file", (F.col("part") + 1).alias("part"), F.col("partial").alias("__open"))
    last = units.groupBy("file_id", "file").agg(F.max("part").alias("__last"))
    joined = units.join(before, ["file_id", "file", "part"], "left").join(last, ["file_id", "file"])
    block, entered = F.col("kind").isin(*BLOCKS), ~F.coalesce("__open", F.lit(False))
    begun = F.col("records") - F.when(F.col("partial"), 0).otherwise(1) + entered.cast("long")
    out = joined.withColumn("entered", entered).withColumn("records", F.when(block, begun).otherwise(F.col("records")))
    return cut(out.withColumn("partial", F.col("partial") & (~block | (F.col("part") == F.col("__last")))).drop("__open", "__last"))


def with_cut_frames(units: DataFrame) -> DataFrame:
    """Counted units of whole files, in which the frames of files that are cut inside records are blocks and counted so.

    Such a file has a frame, not its last, that ends without a line feed.
    """
    open_ones = units.filter("kind = 'seekable' AND partial")
    if open_ones.isEmpty():
        return units
    last = units.groupBy("file_id", "file").agg(F.max("part").alias("__last"))
    files = open_ones.join(last, ["file_id", "file"]).filter("part < __last").select("file_id", "file", F.lit(True).alias("__cut")).distinct()
    marked = cut(units.join(files, ["file_id", "file"], "left"))
    own, others = marked.filter("__cut").drop("__cut"), marked.filter("__cut IS NULL").drop("__cut")
    if own.isEmpty():
        return units
    feeds = F.col("records") - F.col("partial").cast("long")
    return others.unionByName(_entered(own.withColumn("kind", F.lit("cut-frame")).withColumn("records", feeds).drop("entered")).select(*units.columns))


def cut_inside(some: DataFrame, every: DataFrame) -> bool:
    """Whether one of ``some`` counted frames, of the planned units ``every``, ends inside a record."""
    last = every.groupBy("file_id", "file").agg(F.max("part").alias("__last"))
    return some.filter("kind = 'seekable' AND partial").join(last, ["file_id", "file"]).filter("part < __last").first() is not None


def placed(units: DataFrame) -> DataFrame:
    """Counted units with ``unit``, their number in the order of the input, first_pos and first_byte.

    Bytes are those of all records with their line ends, one input after the other.
    """
    numbered = with_position(with_cut_frames(units), "file_id", "file", "part", name="unit")
    numbered = running_before(numbered, "unit", "records", name="first_pos").withColumn("__n", F.col("bytes") + F.col("partial").cast("long"))
    return cut(running_before(numbered, "unit", "__n", name="first_byte").drop("__n"))


def units_of(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES, kind: str | None = None) -> DataFrame:
    return placed(counted(plan(spark, paths, range_bytes, kind)))


def kept_units(spark: SparkSession, paths: list[str], where: str, range_bytes: int = RANGE_BYTES, meter: Accumulator | None = None) -> tuple[DataFrame, int, int]:
    """The placed units of ``paths``, and how many files' were found under ``where`` and how many had to be read.

    Units are kept by file with its length and time of change; only files that are new or changed are counted, and then
    a new table is kept beside the older ones, under a name made of the files as they are.
    """
    files = cut(files_of(spark, paths))
    rows = files.select(F.sha2(F.concat_ws("|", "file_id", "path", "length", "at"), 256).alias("h"))
    state = rows.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("h"))), 256)).first()[0]  # a hash a file
    folder = f"{where}/{hashlib.sha256(chr(0).join([str(range_bytes), *paths]).encode()).hexdigest()[:16]}"
    n = files.count()
    older = _tables_under(folder)
    if state in older:
        return spark.read.parquet(f"{folder}/{state}").drop("__length", "__at"), n, 0
    known = None
    if older:
        known = spark.read.parquet(f"{folder}/{older[-1]}")
        same = files.select("file_id", F.col("path").alias("file"), F.col("length").alias("__length"), F.col("at").alias("__at"))
        known = known.join(same, ["file_id", "file", "__length", "__at"], "left_semi")
        changed = files.join(known.select("file_id", F.col("file").alias("path")).distinct(), ["file_id", "path"], "left_anti")
    else:
        changed = files
    fresh = counted(plan_files(cut(changed), range_bytes), meter)
    fresh = fresh.join(files.select("file_id", F.col("path").alias("file"), F.col("length").alias("__length"), F.col("at").alias("__at")), ["file_id", "file"])
    every = fresh if known is None else fresh.unionByName(known.select(*fresh.columns))
    placed(every).write.mode("overwrite").parquet(f"{folder}/{state}")
    return spark.read.parquet(f"{folder}/{state}").drop("__length", "__at"), n - changed.count(), changed.count()


def _tables_under(folder: str) -> list[str]:
    """Names of the finished tables in a folder, the newest last."""
    from pyarrow import fs

    where, name = store(folder)
    found = where.get_file_info(fs.FileSelector(name, allow_not_found=True, recursive=True))
    done = [f for f in found if f.base_name == "_SUCCESS"]
    return [f.path.rsplit("/", 2)[1] for f in sorted(done, key=lambda f: (f.mtime, f.path))]


RECORD = "file_id int, file string, unit long, id long, pos long, offset long, start long, record binary, nbytes long"


def records_of(units: DataFrame, meter: Accumulator | None = None) -> DataFrame:
    """The records of placed units, in order over the partitions: see RECORD. ``start`` is the place among all bytes, ``offset`` that in the file or frame."""

    def run(batches):
        for batch in batches:
            for unit in batch.to_pylist():
                if meter is not None:
                    meter.add(1)
                pos, skew = unit["first_pos"], unit["first_byte"] - (unit["begin"] if unit["kind"] == "plain" else 0)
                for first, raw in pieces(unit):
                    lines = lines_of(raw)
                    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)) + 1
                    offsets = first + np.cumsum(sizes) - sizes
                    place = pa.array(np.arange(pos, pos + len(lines)))
                    pos += len(lines)
                    whole = [pa.array([unit[c]] * len(lines), t) for c, t in (("file_id", pa.int32()), ("file", pa.string()), ("unit", pa.int64()))]
                    columns = [*whole, place, place, pa.array(offsets), pa.array(offsets + skew), pa.array(lines, pa.binary()), pa.array(sizes)]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RECORD.split(", ")])

    return in_tasks(units, "unit").mapInArrow(run, RECORD)


def some_of(units: DataFrame, n: int) -> DataFrame:
    """At most ``n`` planned units, the same ones in every run, ready to be read; their records have no places."""
    numbered = with_position(units, "file_id", "file", "part", name="unit")
    some = numbered.orderBy(prf_hex(0, "analyze", 0, "unit"), "unit").limit(n)
    return some.withColumn("first_pos", F.lit(0).cast("long")).withColumn("first_byte", F.lit(0).cast("long"))


def chunk_shuffled(units: DataFrame, seed: int = 0, epoch: int = 0, rank: int | None = None, world: int | None = None, out_pos: bool = True, meter: Accumulator | None = None) -> DataFrame:
    """Units permuted, records permuted within units; only the rank's units are read. Frames must hold whole records.

    frame_id (the unit), frame_pos, rec (place in the unit), rec_pos, record, nbytes, in output order over the
    partitions. Places among all of the rank's records, ``out_pos``, need its units counted, unless they are already.
    """
    if units.filter(F.col("kind").isin(*WHOLE)).first():
        raise ModeUnavailable("files that can only be read from their beginning have no chunks: convert them first")
    order = place_by_hash(units.withColumn("frame_id", F.col("unit")), prf_hex(seed, "perm", epoch, "frame_id"), "frame_id", name="frame_pos")
    chosen = of_rank(order, rank, world, "frame_pos")
    if out_pos:
        if "records" not in chosen.columns:
            chosen = counted(chosen, meter)
            if cut_inside(chosen, units):
                raise ModeUnavailable("frames that are cut inside records can't be shuffled as chunks: convert the files first")
        chosen = running_before(chosen, "frame_pos", "records", name="before")
    else:
        chosen = chosen.withColumn("before", F.lit(0).cast("long"))
    names = ["frame_id", "frame_pos", "rec", "rec_pos", "out_pos", "record", "nbytes"]

    def run(batches):
        for batch in batches:
            for unit in batch.to_pylist():
                if meter is not None:
                    meter.add(1)
                lines = [x for _, raw in pieces(unit) for x in lines_of(raw)]
                if not lines:
                    continue
                stem = f"{VERSION}|{seed}|frame|{epoch}|{unit['frame_id']}|"
                keys = [hashlib.sha256(f"{stem}{i}".encode()).digest() for i in range(len(lines))]
                order = np.array(sorted(range(len(lines)), key=lambda i: (keys[i], i)))
                n = len(lines)
                whole = [pa.array(np.full(n, unit[c], dtype=np.int64)) for c in ("frame_id", "frame_pos")]
                mixed = [lines[i] for i in order]
                yield pa.RecordBatch.from_arrays([*whole, pa.array(order), pa.array(np.arange(n)), pa.array(np.arange(unit["before"], unit["before"] + n)), pa.array(mixed, pa.binary()), pa.array([len(x) + 1 for x in mixed], pa.int64())], names=names)

    shuffled = in_tasks(cut(chosen), "frame_pos").mapInArrow(run, "frame_id long, frame_pos long, rec long, rec_pos long, out_pos long, record binary, nbytes long")
    return shuffled if out_pos else shuffled.drop("out_pos")


def at_positions(units: DataFrame, wanted: DataFrame, meter: Accumulator | None = None) -> DataFrame:
    """pos, record and the other columns of ``wanted``, which has pos: only units that hold a wanted record are read.

    Positions meet units in buckets of about a unit's records, of which a unit lies in few.
    """
    n, total = units.agg(F.count("*"), F.coalesce(F.sum("records"), F.lit(0))).first()
    bits = max(0, (total // max(1, n)).bit_length() - 1)
    holding = units.filter("records > 0").withColumn("__bucket", F.explode(F.sequence(F.shiftright("first_pos", bits), F.shiftright(F.col("first_pos") + F.col("records") - 1, bits))))
    near = wanted.withColumn("__bucket", F.shiftright("pos", bits)).join(holding.select("unit", "first_pos", "records", "__bucket"), "__bucket")
    inside = near.filter((F.col("pos") >= F.col("first_pos")) & (F.col("pos") < F.col("first_pos") + F.col("records")))
    others = [f for f in wanted.schema.fields if f.name != "pos"]
    asked = inside.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct((F.col("pos") - F.col("first_pos")).alias("at"), *(f.name for f in others)))).alias("asked"))  # a unit's records at most
    work = cut(units.join(asked, "unit"))
    shape = ", ".join(["pos long", "record binary", *(f"`{f.name}` {f.dataType.simpleString()}" for f in others)])

    def run(batches):
        for batch in batches:
            lists = batch.column("asked")
            for i, unit in enumerate(batch.drop_columns(["asked"]).to_pylist()):
                if meter is not None:
                    meter.add(1)
                asked = lists[i].values
                at = asked.field("at").to_numpy()
                found, seen = [], 0
                for _, raw in pieces(unit):
                    lines = lines_of(raw)
                    a, b = np.searchsorted(at, [seen, seen + len(lines)])
                    found += [lines[k - seen] for k in at[a:b].tolist()]
                    seen += len(lines)
                    if len(found) == len(at):
                        break
                yield pa.RecordBatch.from_arrays([pa.array(at + unit["first_pos"]), pa.array(found, pa.binary()), *(asked.field(f.name) for f in others)], names=["pos", "record", *(f.name for f in others)])

    return in_tasks(work).mapInArrow(run, shape)


def sample_of(units: DataFrame, n: int, seed: int = 0, epoch: int = 0, meter: Accumulator | None = None) -> DataFrame:
    """The first ``n`` records of the permutation of all, by their positions alone: pos, record, out_pos."""
    total = units.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    positions = units.sparkSession.range(total).select(F.col("id").alias("pos"))
    return at_positions(units, sample(positions, n, seed, epoch, "pos"), meter)


KEPT_PROBLEMS = 8


def checked(units: DataFrame, max_line: int, deep: bool) -> DataFrame:
    """``units`` with what is found in each, in one pass: records, bytes, oversized, invalid_json, partial, problem (of a frame) and first.

    ``first`` has the first records of a unit that aren't JSON: their place in it, kind and byte. A frame that doesn't
    unpack to the size and checksum of its entry has a problem, and its records aren't looked at. Files whose frames
    turn out to be cut inside records are looked at once more, record by record.
    """
    names = ["records", "bytes", "oversized", "invalid_json", "partial", "problem", "first"]
    of_json = pa.list_(pa.struct([("rec", pa.int64()), ("kind", pa.string()), ("at", pa.int64())]))

    def look(unit: dict) -> tuple:
        records = size = oversized = invalid = 0
        last, problem, first = b"\n", None, []
        try:
            blocks = list(pieces(unit)) if unit["kind"] == "cut-frame" else pieces(unit)  # a frame, and the rest of its last record
        except Exception as e:
            return 0, 0, 0, 0, False, f"unreadable: {e}", []
        for _, raw in blocks:
            if unit["kind"] == "seekable":
                problem = frame_problem(raw, unit["size"], unit["checksum"])
                if problem:
                    return 0, 0, 0, 0, False, problem, []
            for line in lines_of(raw):
                oversized += len(line) + 1 > max_line
                if deep and (found := json_problem_of(line)):
                    invalid += 1
                    if len(first) < KEPT_PROBLEMS:
                        first.append({"rec": records, "kind": found[0], "at": found[1]})
                records += 1
            size += len(raw)
            last = raw[-1:]
        return records, size, oversized, invalid, last != b"\n", problem, first

    def run(batches):
        for batch in batches:
            found = [look(unit) for unit in batch.to_pylist()]
            kinds = (*[pa.int64()] * 4, pa.bool_(), pa.string(), of_json)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 7, kinds))], names=[*batch.schema.names, *names])

    shape = "records long, bytes long, oversized long, invalid_json long, partial boolean, problem string, first array<struct<rec: long, kind: string, at: long>>"

    def looked_at(units: DataFrame) -> DataFrame:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema.fields)
        return cut(in_tasks(units).mapInArrow(run, f"{kinds}, {shape}"))

    units = units.select(*NAMES, F.lit(True).alias("entered")) if units.filter("kind = 'xz-block'").isEmpty() else counted(units).select(*NAMES, "entered")
    found = looked_at(units)
    marked = with_cut_frames(found)
    cut_ones = marked.filter("kind = 'cut-frame'")
    if marked is found or cut_ones.isEmpty():
        return found
    at = ["file_id", "file", "part"]
    again = looked_at(cut_ones.select(*NAMES, "entered")).withColumnRenamed("problem", "__later").join(cut_ones.select(*at, "problem", F.col("bytes").alias("__bytes"), F.col("partial").alias("__partial")), at)
    again = again.withColumns({"problem": F.coalesce("problem", "__later"), "bytes": F.col("__bytes"), "partial": F.col("__partial")})
    return cut(marked.filter("kind <> 'cut-frame'").unionByName(again.select(*found.columns)))


def report(found: DataFrame) -> DataFrame:
    """One row of ``checked`` units: records, bytes, oversized, invalid_json, trailing_partial (files), seekable_files, bad_frames and ok."""
    total = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long").alias(name)
    framed = F.col("kind").isin("seekable", "cut-frame")
    row = found.agg(
        *(total(F.col(c), c) for c in ("records", "bytes", "oversized", "invalid_json")),
        total(F.col("partial") & ~framed, "trailing_partial"),
        F.countDistinct(F.when(framed, F.struct("file_id", "file"))).alias("seekable_files"),
        total(F.col("problem").isNotNull(), "bad_frames"),
    )
    return row.withColumn("ok", F.expr("oversized = 0 AND invalid_json = 0 AND trailing_partial = 0 AND bad_frames = 0"))


def first_problems(found: DataFrame, n: int = KEPT_PROBLEMS) -> DataFrame:
    """The first records of ``checked`` units that aren't JSON: file, part (of the file), rec (in the part), kind, at."""
    return found.select("file_id", "file", "part", F.explode("first").alias("p")).select("file_id", "file", "part", "p.*").orderBy("file_id", "file", "part", "rec").limit(n)
