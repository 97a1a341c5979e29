"""``python -m millrace COMMAND``: stream, convert, info, analyze, index, verify, serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.prf import client_seed
from .functions.records import humanize, parse_size
from .operators import analyze, frames, index, records
from .operators.errors import BadData, CorpusError, OutputFailed, RecordTooLong
from .operators.shared import cut
from .sources import jsonl, seekable, shards, units
from .streaming.dataset import MODES, Dataset, UnitDataset, shuffles_units


def is_parquet(path: str) -> bool:
    return path.startswith("hf://") or path.endswith(".parquet")


def in_files(spark: SparkSession, paths: list[str]) -> bool:
    """Whether all inputs are files of lines that tasks can read."""
    return not any(is_parquet(p) for p in paths) and all(units.streamable(spark, p) for p in paths)


def spooled(spark: SparkSession, paths: list[str], stdin=None) -> list[str]:
    """``paths`` with standard input written to the shared folder."""
    return [jsonl.spool(spark, stdin or sys.stdin.buffer) if p == "-" else p for p in paths]


def from_shards(spark: SparkSession, path: str, columns: list[str] | None, cache: str) -> DataFrame:
    """Rows of Parquet shards as JSON records: file, row and record."""
    rows = shards.read_shards(spark, shards.local_copy(path, cache) if path.startswith("hf://") else path, columns)
    kept = rows.drop("file", "row") if columns is None else rows.select(*columns)
    return rows.select("file", "row", jsonl.to_json_record(kept).cast("binary").alias("record"))


def corpus(spark: SparkSession, paths: list[str], kind: str | None = None, columns: list[str] | None = None, cache: str = ".", units_kept: DataFrame | None = None) -> DataFrame:
    """Records of all inputs, with id, pos, nbytes (with the line end) and record (bytes).

    Records of files are placed by their units, so no text is moved, and lie in order over the partitions. Rows of
    Parquet files, and files of stores that only Spark reads, are put in order by sorting.
    """
    if units_kept is not None:
        return units.records_of(units_kept)
    if in_files(spark, paths):
        return units.records_of(units.units_of(spark, paths, kind=kind))
    read = records.concat(*(from_shards(spark, p, columns, cache) if is_parquet(p) else jsonl.read_records(spark, p, kind) for p in paths))
    read = read.withColumn("nbytes", (F.octet_length("record") + 1).cast("long"))
    return records.with_position(read, "file_id", "file", "row").withColumn("id", F.col("pos"))


def converted(spark: SparkSession, rows: DataFrame, out: str, frame_size: int, check: bool, in_order: bool = False, level: int = 3, checksum: bool = True, most: int | None = None, aligned: bool = True) -> dict:
    """Writes ``rows`` as seekable files; what was written, and with ``check`` how many frames of it are bad.

    Records are counted as they are written. ``most``: bytes that ``rows`` have at most, if known. Frames that aren't
    ``aligned`` are cut inside records, at exactly ``frame_size`` bytes.
    """
    counts = Observation()
    spread = None if most is None else (max(1, -(-most // units.TASK_BYTES)), most // frame_size + 1)
    try:
        if aligned:
            framed = frames.assign_frames(rows, frame_size, in_order=in_order)
            seekable.write_seekable(framed, out, level, checksum, counts, spread)
        else:
            seekable.write_cut(rows, out, frame_size, level, checksum, counts, in_order)
    except Exception as e:
        if any(x in str(e) for x in ("Permission denied", "Read-only", "Not a directory", "No space left")):
            raise OutputFailed(f"cannot write {out}") from e
        raise
    about = seekable.info(spark, out).first().asDict()
    about["records"] = counts.get["records"]
    if check:
        about["bad_frames"] = seekable.verify_frames(spark, out).count()
    return about


def streamed(spark: SparkSession, a, out) -> None:
    """Writes the shuffled records of ``stream``'s arguments, and says how many were dropped."""
    seed = a.seed if a.client is None else client_seed(a.seed, a.client)
    paths = spooled(spark, a.paths)
    dropped = spark.sparkContext.accumulator(0)
    found = None
    if in_files(spark, paths):
        if a.index:
            found, hits, read = units.kept_units(spark, paths, a.index)
            print(f"millrace: index of {hits} files found and of {read} built under {a.index}", file=sys.stderr)
        else:
            found = units.units_of(spark, paths, a.frame_size)
        if not shuffles_units(found, a.shuffle):
            found = None
    rows = corpus(spark, paths, units_kept=found)
    if a.on_error == "fail" and (n := records.too_long(rows, a.max_line)):
        raise RecordTooLong(f"{n} records exceed --max-line ({humanize(a.max_line)})")
    if found is not None:
        lines = UnitDataset(found, a.shuffle, seed, a.epochs, a.sample, rank=a.rank, world_size=a.world_size, max_line=a.max_line if a.on_error == "skip" else None, dropped=dropped)
    else:
        observed = Observation()
        rows = rows.observe(observed, F.count_if(F.col("nbytes") > a.max_line).alias("long"))
        rows = records.cut(records.limit_length(rows, a.max_line, a.on_error))
        dropped.add(observed.get["long"] if a.on_error == "skip" else 0)
        if a.shuffle == "chunk-shuffled":
            rows = frames.assign_frames(rows, a.frame_size)
        lines = Dataset(rows, a.shuffle, seed, a.epochs, a.sample, rank=a.rank, world_size=a.world_size, size=a.size)
    for line in lines:
        out.write(line)
    if dropped.value:
        print(f"millrace: dropped {dropped.value} records exceeding --max-line ({humanize(a.max_line)}); raise it or pass --on-error passthrough to keep them", file=sys.stderr)


def serving(spark: SparkSession, a):
    """The NDJSON server of the command line's datasets. Files are planned and counted once, before it listens; requests read units."""
    from .streaming.serve import server

    tokens = [line.strip() for line in open(a.tokens, encoding="utf-8") if line.strip()] if a.tokens else None
    catalogue = index.Catalogue(spark, [tuple(x.split("=", 1)) if "=" in x else (x.rstrip("/").rsplit("/", 1)[-1], x) for x in a.datasets])
    found = {}
    for path, _ in catalogue.entries.values():
        if in_files(spark, [path]):
            found[path] = units.kept_units(spark, [path], a.index)[0] if a.index else units.units_of(spark, [path], a.frame_size)
        else:
            found[path] = frames.assign_frames(corpus(spark, [path]), a.frame_size, in_order=True)
    return server(catalogue, found.__getitem__, tokens, a.host, a.port)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("stream", "convert", "analyze", "index", "verify"):
        c = commands.add_parser(name)
        c.add_argument("paths", nargs="+")
        if name in ("stream", "verify"):
            c.add_argument("--max-line", type=parse_size, default=records.DEFAULT_MAX_LINE)
        c.add_argument("--frame-size", type=parse_size, default=frames.DEFAULT_FRAME)
        c.add_argument("--seed", type=int, default=0)
        if name == "stream":
            c.add_argument("--on-error", choices=("skip", "passthrough", "fail"), default="skip")
            c.add_argument("--shuffle", choices=MODES, default="chunk-shuffled")
            c.add_argument("--epochs", type=int, default=1)
            c.add_argument("--client", help="a name that gives a client a seed of its own, made of --seed")
            for n in ("sample", "rank", "world-size", "size"):
                c.add_argument(f"--{n}", type=int)
            c.add_argument("--index", help="a folder in which the places of the input's records are kept, and used while the input is unchanged")
        if name in ("convert", "index"):
            c.add_argument("-o", "--output", required=True)
        if name == "convert":
            c.add_argument("--verify", action="store_true")
            c.add_argument("--limit", type=int)
            c.add_argument("--sample-rate", type=float)
            c.add_argument("--min-entropy", type=float)
            c.add_argument("--max-entropy", type=float)
            c.add_argument("--level", type=int, default=3)
            c.add_argument("--no-checksum", action="store_true")
            c.add_argument("--no-record-align", action="store_true", help="cut frames at their size, inside records")
            c.add_argument("--input-format", choices=("plain", "gzip", "zstd", "bzip2", "xz"))
            c.add_argument("--parquet-project", metavar="COLUMN,...")
            c.add_argument("--cache", default=".", help="where the shards of hf:// addresses lie")
        if name == "analyze":
            c.add_argument("--strict", action="store_true")
            c.add_argument("--sample-chunks", type=int, default=analyze.SAMPLE_FRAMES)
        if name == "verify":
            c.add_argument("--deep", action="store_true")
    commands.add_parser("info").add_argument("path")
    c = commands.add_parser("serve")
    c.add_argument("datasets", nargs="+", metavar="NAME=PATH")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=9000)
    c.add_argument("--tokens", help="a file of bearer tokens, one a line")
    c.add_argument("--index", help="a folder in which the places of the inputs' records are kept")
    c.add_argument("--frame-size", type=parse_size, default=frames.DEFAULT_FRAME)
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    try:
        if a.command == "info":
            print(seekable.info(spark, a.path).toJSON().first())
            return 0
        if a.command == "verify":
            looked = units.checked(units.plan(spark, spooled(spark, a.paths)), a.max_line, a.deep)
            found = units.report(looked).first().asDict()
            print(json.dumps(found))
            for r in units.first_problems(looked, 3).collect() if found["invalid_json"] else []:
                print(f"millrace: {r['file']}, part {r['part']}, record {r['rec']}: {r['kind'].replace('_', ' ')} at byte {r['at']}", file=sys.stderr)
            return 0 if found["ok"] else BadData.code
        if a.command == "serve":
            running = serving(spark, a)
            print(f"millrace: listening on {a.host}:{running.server_address[1]}", file=sys.stderr, flush=True)
            running.serve_forever()
            return 0
        if a.command == "stream":
            streamed(spark, a, sys.stdout.buffer)
            return 0
        paths = spooled(spark, a.paths)
        if a.command == "convert":
            placed = units.units_of(spark, paths, kind=a.input_format) if in_files(spark, paths) else None
            most = placed.agg(F.coalesce(F.sum(F.col("bytes") + 1), F.lit(0))).first()[0] if placed is not None else None
            rows = corpus(spark, paths, a.input_format, a.parquet_project.split(",") if a.parquet_project else None, a.cache, placed)
            if a.sample_rate is not None:
                rows = records.bernoulli(rows, a.sample_rate, a.seed)
            if a.min_entropy is not None or a.max_entropy is not None:
                rows = records.entropy_gate(rows, a.min_entropy, a.max_entropy)
            if a.limit is not None:
                rows = records.head(rows, a.limit)
            about = converted(spark, rows, a.output, a.frame_size, a.verify, a.limit is None, a.level, not a.no_checksum, most, not a.no_record_align)
            print(json.dumps(about), file=sys.stderr)
            if about.get("bad_frames"):
                raise BadData(f"{about['bad_frames']} frames of {a.output} are bad")
        elif a.command == "analyze":
            planned = units.plan(spark, paths) if in_files(spark, paths) else None
            framed = planned is not None and not planned.isEmpty() and planned.filter("kind <> 'seekable'").isEmpty()
            sampled = cut(units.some_of(planned, a.sample_chunks)) if framed else None
            if framed and not units.cut_inside(units.counted(sampled), planned):
                some = units.records_of(sampled).withColumnRenamed("unit", "frame_id")  # of the files' own frames
                found, drift = analyze.report(some, a.sample_chunks, a.strict), analyze.drift(some, a.sample_chunks)
            else:
                rows = corpus(spark, paths)
                narrow = frames.assign_frames(rows.select("id", "pos", "nbytes"), a.frame_size, in_order=True)
                found, drift = analyze.report(narrow, a.sample_chunks, a.strict, rows), analyze.drift(narrow, a.sample_chunks, rows)
            print(json.dumps(found.first().asDict() | drift.first().asDict()))
        elif a.command == "index":
            kept, hits, read = units.kept_units(spark, paths, f"{a.output}/_units")
            print(f"millrace: index of {hits} files found and of {read} built", file=sys.stderr)
            if read:
                places = units.records_of(kept).select("id", F.col("pos").alias("idx"), "start", (F.col("start") + F.col("nbytes")).alias("end"))
                for old in seekable.files_of(a.output, ".parquet"):
                    seekable.remove(old)
                places.write.mode("append").parquet(a.output)
        return 0
    except CorpusError as e:
        print(f"millrace: {e}", file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main())
