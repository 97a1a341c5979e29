import argparse
import bz2
import gzip
import itertools
import json
import lzma
import random
import time

import pytest
import zstandard
from pyspark.sql import functions as F

from millrace.__main__ import main, serving
from millrace.operators import frames, index, records, shuffle
from millrace.operators.errors import InputMissing, ModeUnavailable, UsageError
from millrace.plans import catalogue
from millrace.sources import jsonl, seekable, shards, units
from millrace.streaming import live
from millrace.streaming.dataset import Dataset, UnitDataset

#: Carriage returns, zeros, characters of several bytes and bytes that are no characters.
RAW = "one\r\nt\0wo\n☃snowman".encode() + b"\xff\xc3\n"


@pytest.mark.parametrize("name", ["a.jsonl", "a.gz", "a.bz2", "a.zst", "a.xz", "gz_without_suffix", "xz_named.txt", "no_newline"])
def test_codecs_are_found_by_content(spark, tmp_path, name):
    raw = RAW.rstrip(b"\n") if name == "no_newline" else RAW
    pack = gzip.compress if "gz" in name else bz2.compress if "bz2" in name else zstandard.ZstdCompressor().compress if "zst" in name else lzma.compress if "xz" in name else bytes
    (tmp_path / name).write_bytes(pack(raw))
    rows = jsonl.read_records(spark, str(tmp_path / name)).orderBy("row").collect()
    assert [bytes(r["record"]) for r in rows] == raw.rstrip(b"\n").split(b"\n")
    found = units.records_of(units.units_of(spark, [str(tmp_path / name)], 7)).collect()
    assert [(r["pos"], r["offset"], r["start"], bytes(r["record"])) for r in found] == [(0, 0, 0, b"one\r"), (1, 5, 5, b"t\0wo"), (2, 10, 10, RAW.split(b"\n")[2])]


def test_only_the_first_bytes_of_a_file_are_looked_at(spark, tmp_path):
    long_one = b"x" * 300_000 + b"\n" + b"y\n" * 10_000
    for name, raw in (("plain.txt", long_one), ("a.xz", lzma.compress(long_one)), ("gz_elsewhere", gzip.compress(long_one)), ("plain.gz", long_one), ("empty", b"")):
        (tmp_path / name).write_bytes(raw)
    was = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    try:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10")
        assert [k for _, k in jsonl._heads(spark, str(tmp_path))] == ["xz", "gzip", "plain", "plain"]  # empty files aren't listed
        for name in ("plain.txt", "a.xz", "gz_elsewhere", "plain.gz"):
            rows = jsonl.read_records(spark, str(tmp_path / name)).orderBy("row").collect()
            assert b"".join(r["record"] + b"\n" for r in rows) == long_one
        assert jsonl.read_records(spark, str(tmp_path / "empty")).count() == 0
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", was)


def test_refused_inputs(spark, tmp_path):
    (tmp_path / "x.lz4").write_bytes(b"\x04\x22\x4d\x18rest")
    with pytest.raises(ModeUnavailable):
        jsonl.read_records(spark, str(tmp_path / "x.lz4"))
    (tmp_path / "x.data").write_bytes(b"PAR1rest")
    for name, error in (("missing", InputMissing), ("x.data", UsageError), ("x.lz4", ModeUnavailable)):
        with pytest.raises(error):
            jsonl.read_records(spark, str(tmp_path / name))
        with pytest.raises(error):
            units.plan(spark, [str(tmp_path / name)])


def test_rows_as_json(spark):
    df = spark.sql("SELECT 2 AS b, float('nan') AS a, cast('ab' AS binary) AS c, array(1.5D, double('inf')) AS d, date'2020-01-01' AS e, cast(null AS string) AS f")
    assert json.loads(df.select(jsonl.to_json_record(df)).first()[0]) == {"a": None, "b": 2, "c": "6162", "d": [1.5, None], "e": "2020-01-01", "f": None}
    strict = df.select(jsonl.to_json_record(df, strict=True)).first()[0]
    assert json.loads(strict)["e"] is None and list(json.loads(strict)) == list("abcdef")


def test_written_lines_keep_their_order(spark, tmp_path):
    df = shuffle.index_perm(spark.range(100).select("id", F.col("id").cast("string").alias("record")), 1)
    jsonl.write_records(df, str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [r["record"] for r in df.orderBy("out_pos").collect()]


def corpus(spark, n=300):
    df = spark.range(n).select("id", F.col("id").alias("pos"), F.concat(F.lit("rec "), F.col("id").cast("string")).alias("record"))
    return df.withColumn("nbytes", (F.octet_length("record") + 1).cast("long"))


def test_lines_of_text_come_back_as_text(spark, tmp_path):
    props = [f'{{"k": {i}}}' for i in range(40)] + ["", "\r", "☃ é\0", " \t"]
    spark.createDataFrame([(len(props) - i, p) for i, p in enumerate(props)], "event_id long, props string").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    back = catalogue.QUERIES["jsonl_round_trip"](spark, str(tmp_path))
    assert dict(back.dtypes) == {"pos": "bigint", "record": "string"}
    assert [r["record"] for r in back.orderBy("pos").collect()] == props[::-1]


def test_seekable_round_trip(spark, tmp_path):
    framed = frames.assign_frames(corpus(spark), 256)
    out = str(tmp_path / "seek")
    seekable.write_seekable(framed, out)
    back = seekable.read_seekable(spark, out)
    assert sorted(bytes(r["record"]).decode() for r in back.collect()) == sorted(r["record"] for r in framed.collect())
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(open(f, "rb"), read_across_frames=True).read() for f in sorted((tmp_path / "seek").glob("*.zst")))
    assert whole.decode().splitlines() == [f"rec {i}" for i in range(300)]
    n_frames = framed.select("frame_id").distinct().count()
    about = seekable.info(spark, out).first()
    assert about["frames"] == n_frames and about["decompressed"] == len(whole)
    assert seekable.verify_frames(spark, out).count() == 0
    file = sorted((tmp_path / "seek").glob("*.zst"))[0]
    raw = bytearray(file.read_bytes())
    raw[20] ^= 0xFF
    file.write_bytes(raw)
    assert seekable.verify_frames(spark, out).count() >= 1
    file.write_bytes(raw[:-3])
    with pytest.raises(UsageError):
        seekable.read_seek_table(str(file))


def test_shards(spark, tmp_path):
    for i in (2, 0, 1):
        spark.range(10 * i, 10 * i + 10).selectExpr("id", "id * 2 AS twice").coalesce(1).write.parquet(str(tmp_path / f"d{i}"))
        next((tmp_path / f"d{i}").glob("part-*.parquet")).rename(tmp_path / f"train-0000{i}.parquet")
    (tmp_path / "noise.txt").write_text("x")
    df = shards.read_shards(spark, str(tmp_path), ["id"]).orderBy("file", "row")
    assert [r["id"] for r in df.collect()] == list(range(30)) and df.columns == ["file", "row", "id"]
    with pytest.raises(UsageError, match="twice"):
        shards.read_shards(spark, str(tmp_path), ["nope"])


def test_addresses():
    assert shards.parse_address("hf://a/b") == ("a/b", None) and shards.parse_address("hf://a/b@v1") == ("a/b", "v1")
    for bad in ("hf://a", "hf://a b/c", "http://a/b"):
        with pytest.raises(UsageError):
            shards.parse_address(bad)


def test_index_is_used_again_until_the_input_changes(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a\nb\n")
    built = []

    def build():
        built.append(1)
        return spark.range(2)

    for _ in range(2):
        assert index.cached_index(spark, str(tmp_path / "in.txt"), str(tmp_path / "idx"), build).count() == 2
    assert len(built) == 1
    (tmp_path / "in.txt").write_text("a\nb\nc\n")
    index.cached_index(spark, str(tmp_path / "in.txt"), str(tmp_path / "idx"), build)
    assert len(built) == 2
    assert index.looked_up_index(spark, str(tmp_path / "in.txt"), str(tmp_path / "idx"), build)[1] and not index.looked_up_index(spark, str(tmp_path / "in.txt"), str(tmp_path / "other"), build)[1]
    listed = index.Catalogue(spark, [("one", str(tmp_path / "in.txt"))])
    assert listed.as_table().count() == 1 and listed.path("one")
    with pytest.raises(UsageError):
        index.Catalogue(spark, [("bad id", str(tmp_path))])
    with pytest.raises(InputMissing):
        listed.path("two")


@pytest.mark.parametrize("mode", ["none", "buffer", "reservoir", "chunk-shuffled", "index-perm"])
def test_dataset(spark, mode):
    df = frames.assign_frames(corpus(spark, 60), 64).cache()
    want = sorted(f"rec {i}\n".encode() for i in range(60))
    assert sorted(Dataset(df, mode, seed=3)) == want
    assert sorted(x for r in range(3) for x in Dataset(df, mode, seed=3, rank=r, world_size=3)) == want
    assert list(Dataset(df, mode, seed=3, sample=0)) == []
    assert list(Dataset(df, mode, seed=3, seen=50)) == list(Dataset(df, mode, seed=3))[50:]
    assert len(list(Dataset(df, mode, epochs=2, sample=70))) == 70
    twice = Dataset(df, mode, epochs=2, sample=7, sample_scope="epoch")
    assert len(list(twice)) == 14 and twice.counts == {0: 7, 1: 7}
    assert sorted(x for w in range(2) for x in Dataset(df, mode, worker_info=lambda w=w: (w, 2))) == want


def streamed(spark, tmp_path, n):
    corpus(spark, n).coalesce(1).write.parquet(str(tmp_path / "src"))
    return spark.readStream.schema(corpus(spark, 1).schema).parquet(str(tmp_path / "src"))


def test_streaming_reservoir_equals_the_batch_one(spark, tmp_path):
    q = live.reservoir(streamed(spark, tmp_path, 200), 20, 5).writeStream.format("memory").outputMode("complete").queryName("res").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(r["id"] for r in spark.sql("SELECT row.id FROM res").collect())
    assert got == sorted(r["id"] for r in shuffle.reservoir(corpus(spark, 200), 20, 5).collect())


def test_streaming_buffer_equals_the_batch_one(spark, tmp_path):
    q = live.buffer(streamed(spark, tmp_path, 200), 20, 5).writeStream.format("memory").outputMode("append").queryName("buf").start()
    q.processAllAvailable()
    q.stop()
    got = {r["pos"]: r["out_pos"] for r in spark.sql("SELECT * FROM buf").collect()}
    batch = {r["pos"]: r["out_pos"] for r in shuffle.buffer_shuffle(corpus(spark, 200), 20, 5).collect()}
    assert got == {p: o for p, o in batch.items() if o < 180}


def test_endless_epochs(spark):
    seen = {}
    q = live.endless_epochs(spark, corpus(spark, 20), lambda df, n: seen.setdefault(n, [r["id"] for r in df.orderBy("out_pos").collect()]), 3, "0 seconds").start()
    until = time.time() + 60
    while len(seen) < 3 and time.time() < until:
        time.sleep(0.2)
    q.stop()
    assert len(seen) >= 3 and all(sorted(x) == list(range(20)) for x in seen.values()) and seen[0] != seen[1]


def test_mixing_and_concat(spark):
    a, b = spark.range(1000), spark.range(1000)
    got = records.weighted_mix({"a": a, "b": b}, {"a": 1.0, "b": 0.1}, 2).groupBy("input").count().collect()
    counts = {r["input"]: r["count"] for r in got}
    assert counts["a"] == 1000 and 50 < counts["b"] < 160
    assert [r["file_id"] for r in records.concat(a, b).groupBy("file_id").count().orderBy("file_id").collect()] == [0, 1]


def test_command_line(spark, tmp_path, capfdbinary):
    (tmp_path / "in.jsonl").write_text("".join(f'{{"i":{i}}}\n' for i in range(50)))
    path = str(tmp_path / "in.jsonl")
    assert main(["stream", path, "--shuffle", "index-perm", "--sample", "5"]) == 0
    assert len(capfdbinary.readouterr().out.splitlines()) == 5
    assert main(["convert", path, "-o", str(tmp_path / "out"), "--frame-size", "128", "--verify"]) == 0
    said = next(json.loads(x) for x in reversed(capfdbinary.readouterr().err.splitlines()) if x.startswith(b"{"))
    raw = (tmp_path / "in.jsonl").read_bytes()
    assert (said["records"], said["decompressed"], said["bad_frames"]) == (50, len(raw), 0) and said["frames"] > 1 and said["file_bytes"] > said["compressed"]
    assert main(["info", str(tmp_path / "out")]) == 0
    assert main(["verify", path, "--deep"]) == 0
    assert main(["analyze", path, "--frame-size", "64"]) == 0
    assert main(["stream", str(tmp_path / "none")]) == 66


def test_exit_codes(spark, tmp_path, capfdbinary):
    (tmp_path / "in.jsonl").write_text('{"i":1}\n{"long":"' + "x" * 100 + '"}\nno json\n')
    path = str(tmp_path / "in.jsonl")
    assert main(["stream", path, "--shuffle", "none", "--max-line", "50", "--on-error", "fail"]) == 65
    said = capfdbinary.readouterr()
    assert said.out == b"" and b"1 records exceed --max-line (50 B)" in said.err
    assert main(["stream", path, "--shuffle", "none", "--on-error", "fail"]) == 0
    assert main(["verify", path, "--deep"]) == 65
    (tmp_path / "file").write_text("x")
    assert main(["convert", path, "-o", str(tmp_path / "file" / "below")]) == 73
    assert main(["info", path]) == 64


def test_the_server_of_the_command_line(spark, tmp_path):
    import threading
    import urllib.request

    (tmp_path / "in.jsonl").write_text("".join(f'{{"i":{i}}}\n' for i in range(20)))
    a = argparse.Namespace(datasets=[f"one={tmp_path / 'in.jsonl'}"], host="127.0.0.1", port=0, tokens=None, frame_size=64, index=None)
    running = serving(spark, a)
    threading.Thread(target=running.serve_forever, daemon=True).start()

    def get(query):
        with urllib.request.urlopen(f"http://127.0.0.1:{running.server_address[1]}/v1/streams/one?{query}", timeout=120) as r:
            return r.headers["X-Seed"], r.read()

    try:
        for mode in ("none", "chunk-shuffled", "index-perm", "buffer"):
            _, body = get(f"shuffle={mode}&seed=3")
            assert sorted(json.loads(x)["i"] for x in body.splitlines()) == list(range(20))
            assert (body == (tmp_path / "in.jsonl").read_bytes()) == (mode == "none")
        of_clients = {c: get(f"shuffle=index-perm&seed=3&client={c}") for c in ("a", "b")}
        assert of_clients["a"][1] != of_clients["b"][1] and of_clients["a"] == get("shuffle=index-perm&seed=3&client=a")
        assert of_clients["a"][1] == get(f"shuffle=index-perm&seed={of_clients['a'][0]}")[1]  # the seed that was used runs it again
    finally:
        running.shutdown()


def test_failed_attempts_leave_nothing(spark, tmp_path):
    framed = frames.assign_frames(corpus(spark), 256).withColumn("record", F.when(F.col("pos") == 299, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("record")))
    with pytest.raises(Exception, match="broken"):
        seekable.write_seekable(framed, str(tmp_path / "seek"))
    assert not [f for f in (tmp_path / "seek").glob("*")] if (tmp_path / "seek").exists() else True


def test_long_lines_are_dropped_by_stream_alone(spark, tmp_path, capfdbinary):
    long_one = json.dumps("x" * (20 << 20))
    lines = ["1", long_one, "22", "333"]
    path, out = str(tmp_path / "in.jsonl"), str(tmp_path / "out")
    (tmp_path / "in.jsonl").write_text("".join(f"{x}\n" for x in lines))
    assert main(["stream", path, "--shuffle", "none"]) == 0
    said = capfdbinary.readouterr()
    assert said.out.split() == [b"1", b"22", b"333"] and b"dropped 1 records" in said.err
    assert main(["convert", path, "-o", out]) == 0
    assert sorted(r["n"] for r in seekable.read_seekable(spark, out).select(F.length("record").alias("n")).collect()) == sorted(map(len, lines))
    assert main(["index", path, "-o", str(tmp_path / "idx")]) == 0
    first = len(long_one) + 3
    assert [r["start"] for r in spark.read.parquet(str(tmp_path / "idx")).orderBy("idx").collect()] == [0, 2, first, first + 3]
    capfdbinary.readouterr()
    assert main(["verify", path, "--deep"]) != 0
    found = json.loads(capfdbinary.readouterr().out)
    assert (found["records"], found["oversized"], found["ok"], found["bytes"]) == (4, 1, False, sum(map(len, lines)) + 4)
    assert main(["analyze", path, "--frame-size", "8"]) == 0
    assert json.loads(capfdbinary.readouterr().out)["frames"] == 2


@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress])
def test_verify_finds_a_last_line_without_its_end(spark, tmp_path, capfdbinary, pack):
    for raw, partial in ((b"1\n2\n", 0), (b"1\n2", 1)):
        suffix = {gzip.compress: ".gz", bz2.compress: ".bz2"}.get(pack, "")
        (tmp_path / f"a {partial}{suffix}").write_bytes(pack(raw))
        assert (main(["verify", str(tmp_path / f"a {partial}{suffix}")]) != 0) == bool(partial)
        found = json.loads(capfdbinary.readouterr().out)
        assert (found["trailing_partial"], found["bytes"], found["ok"]) == (partial, len(raw), not partial)


def test_verify_checks_the_frames_of_seekable_files(spark, tmp_path, capfdbinary):
    out = tmp_path / "seek"
    seekable.write_seekable(frames.assign_frames(corpus(spark), 256), str(out))
    assert main(["verify", str(out)]) == 0
    found = json.loads(capfdbinary.readouterr().out)
    assert found["records"] == 300 and found["seekable_files"] == len(list(out.glob("*.zst"))) and found["bad_frames"] == 0
    assert main(["verify", str(out), "--deep"]) != 0
    assert json.loads(capfdbinary.readouterr().out)["invalid_json"] == 300
    file = sorted(out.glob("*.zst"))[0]
    raw = bytearray(file.read_bytes())
    raw[20] ^= 0xFF
    file.write_bytes(raw)
    assert main(["verify", str(out)]) != 0
    assert json.loads(capfdbinary.readouterr().out)["bad_frames"] >= 1


def test_standard_input_is_spooled(spark):
    lines = [b"line \xff%d\r\n" % i for i in range(25)] + [b"last"]
    for some in (lines, []):
        out = jsonl.spool(spark, some)
        got = [bytes(r["record"]) for r in units.records_of(units.units_of(spark, [out], 16)).collect()]
        assert got == [x.removesuffix(b"\n") for x in some]


def written(tmp_path, name, lines, end=b"\n"):
    raw = b"\n".join(lines) + end if lines else b""
    (tmp_path / name).write_bytes(raw)
    return raw


@pytest.mark.parametrize("range_bytes", [1, 3, 16, 64, 10_000])
def test_ranges_find_every_record_once(spark, tmp_path, range_bytes, monkeypatch):
    draw = random.Random(range_bytes)
    lines = [bytes(draw.choices(range(11, 256), k=draw.choice([0, 0, 1, 5, 40]))) for _ in range(60)] + [b"x" * 300]
    raw = written(tmp_path, "a.txt", lines, b"") + b"\n" + written(tmp_path, "b.txt", lines[:20]) + written(tmp_path, "c.txt", [b""]) + written(tmp_path, "d.txt", [])
    monkeypatch.setattr(units, "BLOCK_BYTES", 50)
    placed = units.units_of(spark, [str(tmp_path / x) for x in ("a.txt", "b.txt", "c.txt", "d.txt")], range_bytes)
    rows = units.records_of(placed).collect()
    assert [bytes(r["record"]) for r in rows] == [*lines, *lines[:20], b""] and [r["pos"] for r in rows] == list(range(82))
    assert all(raw[r["start"] : r["start"] + r["nbytes"]] == r["record"] + b"\n" for r in rows)
    assert placed.agg(F.sum("records")).first()[0] == 82 and placed.filter("partial").count() == 1


@pytest.mark.parametrize("blocks", [2, 9, 40])
def test_blocks_of_xz_files_are_read_by_several_tasks(spark, tmp_path, capfdbinary, blocks):
    draw = random.Random(blocks)
    lines = [bytes(draw.choices(range(11, 256), k=draw.choice([0, 1, 5, 40]))) for _ in range(60)] + [b"y" * 500, b"end"]
    raw = b"\n".join(lines)
    cuts = sorted({0, len(raw), *draw.choices(range(1, len(raw)), k=blocks)} | ({raw.index(b"\n") + 1} if blocks > 2 else set()))
    packed = b"".join(lzma.compress(raw[a:b], check=draw.choice([lzma.CHECK_CRC32, lzma.CHECK_CRC64, lzma.CHECK_SHA256])) + b"\0" * draw.choice([0, 4]) for a, b in zip(cuts, cuts[1:]))
    path = str(tmp_path / "a.xz")
    (tmp_path / "a.xz").write_bytes(packed)
    placed = units.units_of(spark, [path])
    assert placed.count() == len(cuts) - 1 and placed.filter("kind = 'xz-block'").count() == len(cuts) - 1
    rows = units.records_of(placed).collect()
    assert [bytes(r["record"]) for r in rows] == lines and [r["pos"] for r in rows] == list(range(len(lines)))
    assert all(raw[r["start"] : r["start"] + r["nbytes"] - 1] == r["record"] for r in rows)
    assert [bytes(r["record"]) for r in units.sample_of(placed, 9, 2).sort("out_pos").collect()] == [lines[r["id"]] for r in shuffle.sample(spark.range(len(lines)), 9, 2).sort("out_pos").collect()]
    assert main(["verify", path]) == 65
    found = json.loads(capfdbinary.readouterr().out)
    assert (found["records"], found["bytes"], found["trailing_partial"]) == (len(lines), len(raw), 1)
    (tmp_path / "b.xz").write_bytes(packed.rstrip(b"\0")[:-1])
    assert {r["kind"] for r in units.plan(spark, [str(tmp_path / "b.xz")]).collect()} == {"xz"}


def test_a_rank_reads_its_frames_alone(spark, tmp_path):
    out = str(tmp_path / "seek")
    seekable.write_seekable(frames.assign_frames(corpus(spark, 600), 64), out)
    planned = records.with_position(units.plan(spark, [out]), "file_id", "file", "part", name="unit")
    n, seen, order = planned.count(), [], []
    for rank in range(7):
        meter = spark.sparkContext.accumulator(0)
        rows = units.chunk_shuffled(planned, 5, 1, rank, 7, out_pos=False, meter=meter).collect()
        assert meter.value == len({r["frame_id"] for r in rows}) == len(range(rank, n, 7))
        seen += [bytes(r["record"]) for r in rows]
        placed = units.chunk_shuffled(planned, 5, 1, rank, 7).collect()
        assert [r["out_pos"] for r in placed] == list(range(len(rows))) and [r["record"] for r in placed] == [r["record"] for r in rows]
        order.append([r["frame_pos"] for r in rows])
    assert sorted(seen) == sorted(b"rec %d" % i for i in range(600))
    assert all(x == sorted(x) and {p % 7 for p in x} == {rank} for rank, x in enumerate(order))
    with pytest.raises(ModeUnavailable):
        (tmp_path / "a.gz").write_bytes(gzip.compress(RAW))
        units.chunk_shuffled(units.units_of(spark, [str(tmp_path / "a.gz")]))


def test_a_sample_opens_the_units_that_hold_it(spark, tmp_path):
    lines = [b"rec %d" % i for i in range(20_000)]
    written(tmp_path, "a.txt", lines)
    placed = units.units_of(spark, [str(tmp_path / "a.txt")], 16)
    assert placed.count() > 10_000
    meter = spark.sparkContext.accumulator(0)
    rows = sorted(units.sample_of(placed, 64, 3, meter=meter).collect(), key=lambda r: r["out_pos"])
    assert 0 < meter.value <= 64 and [bytes(r["record"]) for r in rows] == [lines[r["pos"]] for r in rows]
    whole = shuffle.index_perm(spark.range(20_000), 3).orderBy("out_pos").limit(64).collect()
    assert [r["pos"] for r in rows] == [r["id"] for r in whole]


def test_filters_choose_frames_before_they_are_read(spark, tmp_path):
    out = str(tmp_path / "seek")
    framed = frames.assign_frames(corpus(spark, 200), 128)
    seekable.write_seekable(framed.coalesce(1), out)
    plain = seekable.read_seekable(spark, out)
    assert {r["frame_id"] for r in seekable.read_seekable(spark, out, [1, 3]).collect()} == {1, 3}
    reader = seekable._Reader({"path": out})
    kept = list(reader.pushFilters([seekable.In(("frame_id",), (1, 3, 5)), seekable.LessThan(("frame_id",), 5), seekable.EqualTo(("record",), b"x")]))
    assert [type(f) for f in kept] == [seekable.EqualTo] and {f.frame_id for p in reader.partitions() for f in p.value[2]} <= {1, 3}
    seekable.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = spark.read.format("seekable_zstd").option("path", out).load().filter("frame_id < 2")
        assert sorted(bytes(r["record"]) for r in got.collect()) == sorted(bytes(r["record"]) for r in plain.filter("frame_id < 2").collect())
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("mode", ["none", "chunk-shuffled", "index-perm"])
def test_units_are_handed_out_as_records(spark, tmp_path, mode):
    lines = [b"rec %d" % i for i in range(60)]
    written(tmp_path, "a.txt", [*lines, b"x" * 100])
    placed = units.units_of(spark, [str(tmp_path / "a.txt")], 64)
    dropped = spark.sparkContext.accumulator(0)
    make = lambda **more: UnitDataset(placed, mode, 3, max_line=50, dropped=dropped, **more)
    want = sorted(x + b"\n" for x in lines)
    every = list(make())
    assert sorted(every) == want and dropped.value == 1 and (every == [x + b"\n" for x in lines]) == (mode == "none")
    assert sorted(x for r in range(3) for x in make(rank=r, world_size=3)) == want
    assert list(make(sample=0)) == [] and len(list(make(epochs=2, sample=70))) == 70
    assert list(UnitDataset(placed, mode, 3, sample=7)) == list(UnitDataset(placed, mode, 3))[:7]
    assert list(UnitDataset(placed, mode, 3, seen=50)) == list(UnitDataset(placed, mode, 3))[50:]
    with pytest.raises(UsageError):
        UnitDataset(placed, "buffer")


def test_bytes_survive_the_command_line(spark, tmp_path, capfdbinary):
    lines = [b'"one\r"', b'"t\0wo"', b'"\xff\xc3"', "\"☃\"".encode(), b"[1, 2", b"truth"]
    raw = written(tmp_path, "in.jsonl", lines)
    path, out = str(tmp_path / "in.jsonl"), tmp_path / "out"
    assert main(["convert", path, "-o", str(out), "--frame-size", "8", "--no-checksum", "--level", "1", "--verify"]) == 0
    files = sorted(out.glob("*.zst"))
    assert b"".join(zstandard.ZstdDecompressor().stream_reader(open(f, "rb"), read_across_frames=True).read() for f in files) == raw
    assert all(f.checksum is None for x in files for f in seekable.read_seek_table(str(x)))
    capfdbinary.readouterr()
    for source in (path, str(out)):
        assert main(["stream", source, "--shuffle", "none"]) == 0
        assert capfdbinary.readouterr().out == raw
        assert main(["stream", source, "--frame-size", "16"]) == 0
        assert sorted(capfdbinary.readouterr().out.split(b"\n")) == sorted(raw.split(b"\n"))
        assert main(["verify", source, "--deep"]) == 65
        said = capfdbinary.readouterr()
        assert json.loads(said.out)["invalid_json"] == 4 and said.err.count(b" at byte ") >= 3
        assert main(["analyze", source, "--sample-chunks", "2"]) == 0
        assert json.loads(capfdbinary.readouterr().out)["frames"] <= 2


def test_a_saved_index_is_used(spark, tmp_path, capfdbinary):
    written(tmp_path, "in.jsonl", [b"%d" % i for i in range(300)])
    path, idx = str(tmp_path / "in.jsonl"), str(tmp_path / "idx")
    outs = []
    for want in (b"of 0 files found and of 1 built", b"of 1 files found and of 0 built"):
        assert main(["stream", path, "--shuffle", "index-perm", "--sample", "9", "--seed", "4", "--index", idx]) == 0
        said = capfdbinary.readouterr()
        assert b"index " + want in said.err
        outs.append(said.out)
    assert outs[0] == outs[1] and len(set(outs[0].split())) == 9
    for n in (300, 300, 310):
        written(tmp_path, "in.jsonl", [b"%d" % i for i in range(n)])
        assert main(["index", path, "-o", str(tmp_path / "places")]) == 0
        assert spark.read.parquet(str(tmp_path / "places")).count() == n


def test_only_changed_files_are_read_again(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(20):
        written(folder, f"{i:02d}.txt", [b"%d %d" % (i, k) for k in range(30)])

    def look():
        meter = spark.sparkContext.accumulator(0)
        placed, hits, read = units.kept_units(spark, [str(folder)], str(tmp_path / "kept"), 64, meter)
        records_ = units.records_of(placed)
        assert [r["pos"] for r in records_.select("pos").collect()] == list(range(records_.count()))
        return hits, read, meter.value, placed.filter("file like '%/07.txt'").count(), placed.count()

    first = look()
    assert first[:2] == (0, 20) and first[2] == first[4]
    assert look()[:3] == (20, 0, 0)
    written(folder, "07.txt", [b"other %d" % k for k in range(50)])
    changed = look()
    assert changed[:2] == (19, 1) and changed[2] == changed[3] < changed[4] / 5
    written(folder, "20.txt", [b"new"])
    (folder / "03.txt").unlink()
    assert look()[:3] == (19, 1, 1)


def test_parquet_is_converted_row_by_row(spark, tmp_path, capfdbinary):
    spark.range(30).selectExpr("id", "id * 2 AS twice").coalesce(1).write.parquet(str(tmp_path / "d"))
    cache = tmp_path / "cache" / "own" / "set" / "main" / "data"
    cache.mkdir(parents=True)
    next((tmp_path / "d").glob("part-*.parquet")).rename(cache / "train-0.parquet")
    out = str(tmp_path / "out")
    assert main(["convert", "hf://own/set", "-o", out, "--cache", str(tmp_path / "cache"), "--parquet-project", "twice"]) == 0
    got = [json.loads(bytes(r["record"])) for r in seekable.read_seekable(spark, out).orderBy("file_id", "frame_id", "offset_in_frame").collect()]
    assert got == [{"twice": 2 * i} for i in range(30)]
    (tmp_path / "x.data").write_bytes((cache / "train-0.parquet").read_bytes())
    assert main(["stream", str(tmp_path / "x.data"), "--shuffle", "none"]) == 64
    assert main(["convert", str(cache / "train-0.parquet"), "-o", str(tmp_path / "out2")]) == 0


LINES_TO_CUT = [b'"' + b"x" * (i * 37 % 150) + b'"' if i % 9 else b"" for i in range(60)]


@pytest.mark.parametrize("frame_size", [7, 64])
def test_frames_may_be_cut_inside_records(spark, tmp_path, frame_size):
    """Records shorter and longer than frames, empty ones, and frames that happen to end with a record; another file beside."""
    raw = b"".join(x + b"\n" for x in LINES_TO_CUT)
    (tmp_path / "in.jsonl").write_bytes(raw)
    out, path = str(tmp_path / "cut"), str(tmp_path / "in.jsonl")
    seekable.write_cut(spark.createDataFrame(list(enumerate(map(bytearray, LINES_TO_CUT))), "pos long, record binary"), out, frame_size)
    for file in seekable.files_of(out):
        sizes = [f.decompressed for f in seekable.read_seek_table(file)]
        assert set(sizes[:-1]) <= {frame_size} and 0 < sizes[-1] <= frame_size
    back = units.records_of(units.units_of(spark, [path, out])).orderBy("pos").collect()
    assert [bytes(r["record"]) for r in back] == LINES_TO_CUT * 2 and [r["pos"] for r in back] == list(range(120))
    assert [r["start"] for r in back] == list(itertools.accumulate([0] + [len(x) + 1 for x in (LINES_TO_CUT * 2)[:-1]]))
    planned = units.plan(spark, [out])
    told = units.report(units.checked(planned, 100, True)).first()
    long = sum(len(x) + 1 > 100 for x in LINES_TO_CUT)
    assert (told["records"], told["bytes"], told["oversized"], told["invalid_json"], told["bad_frames"]) == (60, len(raw), long, LINES_TO_CUT.count(b""), 0)
    with pytest.raises(ModeUnavailable):
        units.chunk_shuffled(records.with_position(planned, "file_id", "file", "part", name="unit")).count()


def test_cut_frames_on_the_command_line(spark, tmp_path, capfdbinary):
    (tmp_path / "in.jsonl").write_bytes(b"".join(x + b"\n" for x in LINES_TO_CUT))
    out = str(tmp_path / "cut")
    assert main(["convert", str(tmp_path / "in.jsonl"), "-o", out, "--no-record-align", "--frame-size", "64"]) == 0
    assert json.loads(next(x for x in reversed(capfdbinary.readouterr().err.splitlines()) if x.startswith(b"{")))["records"] == 60
    assert main(["stream", out, "--shuffle", "none"]) == 0
    assert capfdbinary.readouterr().out.splitlines() == LINES_TO_CUT
    assert main(["analyze", out]) == 0


def test_reading_on_takes_few_entries_of_a_long_seek_table(tmp_path, monkeypatch):
    lines = [b"x" * (i % 30) for i in range(2_000)]
    lines[50] = b"y" * 3_000  # over 150 frames
    raw = b"".join(x + b"\n" for x in lines)
    parts = [raw[i : i + 20] for i in range(0, len(raw), 20)]
    packed = [zstandard.compress(x) for x in parts]
    (tmp_path / "cut.zst").write_bytes(b"".join(packed) + seekable.seek_table([(len(z), len(x), 0) for z, x in zip(packed, parts)], checksum=False))
    path, frame = str(tmp_path / "cut.zst"), seekable.Frame
    table = seekable.read_seek_table(path)
    assert [*table[:1], *seekable.frames_behind(path, table[0])] == table and not list(seekable.frames_behind(path, table[-1]))
    made = []
    monkeypatch.setattr(seekable, "Frame", lambda *x: made.append(x) or frame(*x))
    read = []
    for f, before in zip(table, [b"\n", *parts]):
        unit = {"file": path, "kind": "cut-frame", "part": f.frame_id, "begin": f.offset, "finish": f.offset + f.compressed, "size": f.decompressed, "checksum": f.checksum}
        read += [x for _, some in units.pieces(unit | {"entered": before.endswith(b"\n")}) for x in seekable.lines_of(some)]
    assert read == lines and len(made) < 20 * len(table)


def test_the_indexes_of_an_xz_file_are_read_once_for_its_blocks(tmp_path, monkeypatch):
    path, looked, read_blocks = str(tmp_path / "a.xz"), [], units.xz.read_blocks
    monkeypatch.setattr(units.xz, "read_blocks", lambda *x: looked.append(x) or read_blocks(*x))
    for lines in ([b"a" * (i % 30) for i in range(300)], [b"b" * (i % 40) for i in range(300)]):  # another file at the same place
        raw = b"".join(x + b"\n" for x in lines)
        parts = [raw[i : i + 50] for i in range(0, len(raw), 50)]
        (tmp_path / "a.xz").write_bytes(b"".join(map(lzma.compress, parts)))
        with open(path, "rb") as f:
            blocks = read_blocks(f, (tmp_path / "a.xz").stat().st_size)
        looked.clear()
        read = []
        for part, (b, before) in enumerate(zip(blocks, [b"\n", *parts])):
            unit = {"file": path, "kind": "xz-block", "part": part, "begin": b.offset, "finish": b.offset + b.packed, "size": b.size, "checksum": b.padding << 16 | b.flags}
            read += [x for _, some in units.pieces(unit | {"entered": before.endswith(b"\n")}) for x in seekable.lines_of(some)]
        assert read == lines and len(looked) == 1
