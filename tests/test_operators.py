import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.records import entropy_of, humanize, json_error, json_problem_of, parse_size
from millrace.operators import analyze, frames, records, shuffle, verify
from millrace.operators.errors import UnsafeOrder, UsageError


def corpus(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return records.record_view(spark.createDataFrame(rows, "id long, text string"), "id", "text").withColumn("pos", F.col("id"))


def numbered(spark, n):
    return spark.range(n).select("id", F.col("id").alias("pos"))


def order_of(df):
    return [r["id"] for r in df.orderBy("out_pos").collect()]


def test_positions_follow_the_order(spark):
    ids = random.Random(3).sample(range(10_000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    got = {r["id"]: r["pos"] for r in records.with_position(df, "id").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}
    assert records.with_position(df.filter("id < 0"), "id").count() == 0


@pytest.mark.parametrize("n", [0, 1, 50, 300])
def test_every_mode_is_a_permutation_and_depends_on_the_seed_alone(spark, n):
    df = numbered(spark, n)
    for mode in (lambda d, s: shuffle.index_perm(d, s), lambda d, s: shuffle.buffer_shuffle(d, 20, s), lambda d, s: shuffle.reservoir(d, 1000, s)):
        a, b = mode(df, 1), mode(df.repartition(5), 1)
        assert order_of(a) == order_of(b)
        assert sorted(order_of(a)) == list(range(n))
        assert sorted(r["out_pos"] for r in a.collect()) == list(range(n))
    if n == 300:
        assert order_of(shuffle.index_perm(df, 1)) != order_of(shuffle.index_perm(df, 2))


def sequential_buffer(n, size, slot, drain):
    ring, out = {}, []
    for i in range(n):
        k = i if i < size else slot[i]
        if i >= size:
            out.append(ring[k])
        ring[k] = i
    return out + sorted(ring.values(), key=lambda i: (drain[i], i))


@pytest.mark.parametrize("size", [1, 2, 7, 60])
def test_buffer_is_the_ring(spark, size):
    from millrace.functions.prf import prf_hex, prf_mod

    df = numbered(spark, 200)
    drawn = {r["pos"]: (r["s"], r["d"]) for r in df.select("pos", prf_mod(5, "buf", 0, size, "pos").alias("s"), prf_hex(5, "drain", 0, "pos").alias("d")).collect()}
    want = sequential_buffer(200, size, {i: s for i, (s, _) in drawn.items()}, {i: d for i, (_, d) in drawn.items()})
    got = order_of(shuffle.buffer_shuffle(df, size, 5))
    assert got == want
    if size == 1:
        assert got == list(range(200))
    assert all(i - k <= size - 1 for k, i in enumerate(got))


def test_reservoir_keeps_each_row_about_as_often(spark):
    seen = [0] * 40
    for seed in range(60):
        rows = [r["id"] for r in shuffle.reservoir(numbered(spark, 40), 10, seed).select("id").collect()]
        assert len(rows) == len(set(rows)) == 10
        for i in rows:
            seen[i] += 1
    assert min(seen) >= 3 and max(seen) <= 30


@pytest.mark.parametrize("world", [1, 2, 3, 8])
def test_ranks_are_disjoint_and_complete(spark, world):
    df = corpus(spark, [f"rec_{i:04d}" for i in range(120)])
    framed = frames.assign_frames(df, 64).cache()
    modes = {
        "none": lambda r: records.of_rank(df, r, world),
        "perm": lambda r: records.of_rank(shuffle.index_perm(df, 3), r, world, "out_pos"),
        "chunk": lambda r: shuffle.chunk_shuffled(framed, 3, rank=r, world=world),
    }
    for mode in modes.values():
        got = [x["id"] for r in range(world) for x in mode(r).select("id").collect()]
        assert sorted(got) == list(range(120))
    assert verify.rank_cover(df, world).first().asDict() == {"n_rows": 120, "covered": 120, "overlap": 0}


def test_chunks_stay_together(spark):
    framed = frames.assign_frames(corpus(spark, ["x" * 30] * 100), 128)
    rows = shuffle.chunk_shuffled(framed, 9).orderBy("out_pos").collect()
    seen = [r["frame_id"] for r in rows]
    assert len([1 for a, b in zip(seen, seen[1:]) if a != b]) == len(set(seen)) - 1
    assert [r["out_pos"] for r in rows] == list(range(100))
    assert len({tuple(r["rec_pos"] for r in rows if r["frame_id"] == f) for f in set(seen)}) == 1


def test_frames_close_at_the_size(spark):
    sizes = random.Random(1).choices(range(1, 90), k=300)
    df = corpus(spark, ["y" * s for s in sizes])
    frame, held, want = 0, 0, []
    for s in sizes:
        want.append(frame)
        held += s + 1
        if held >= 256:
            frame, held = frame + 1, 0
    got = frames.assign_frames(df, 256)
    assert [r["frame_id"] for r in got.orderBy("pos").collect()] == want
    table = frames.frame_table(got).orderBy("frame_id").collect()
    assert [t["start"] for t in table] == [sum(x["bytes"] for x in table[:i]) for i in range(len(table))]
    sizes_sorted = sorted(t["bytes"] for t in table)
    assert frames.frame_info(got).first()["median_frame"] == sizes_sorted[len(sizes_sorted) // 2]


def sequential_frames(sizes, files, frame_size):
    out, current, frame, held = [], None, 0, 0
    for f, n in zip(files, sizes):
        if f != current:
            current, frame, held = f, 0, 0
        out.append(frame)
        held += n
        if held >= frame_size:
            frame, held = frame + 1, 0
    return out


@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.integers(1, 120), st.integers(0, 119))
def test_exits_of_a_run_of_records(sizes, frame_size, entry):
    entry %= frame_size
    frame, held = 0, entry
    for n in sizes:
        held += n
        if held >= frame_size:
            frame, held = frame + 1, 0
    exits = frames._Exits(np.array(sizes), frame_size)
    k = int(np.searchsorted(-exits.low, -entry))
    got = (int(exits.closed[k]), int(exits.held[k])) if k < len(exits.low) else (0, entry + exits.total)
    assert got == (frame, held)


@pytest.mark.parametrize("frame_size", [1, 64, 300, 5_000, 10**9])
def test_frames_over_many_partitions_are_the_sequential_ones(spark, frame_size):
    draw = random.Random(frame_size)
    files = [f"f{i // 70}" if i < 400 else "last" for i in range(900)]
    sizes = [draw.choice([1, 5, 30, 200]) for _ in files]
    df = spark.createDataFrame([(f, i, n, float(i)) for i, (f, n) in enumerate(zip(files, sizes))], "file string, pos long, nbytes long, x double").repartition(5)
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for file in (None, "file"):
            got = {r["pos"]: (r["frame_id"], r["x"]) for r in frames.assign_frames(df, frame_size, file=file).collect()}
            want = sequential_frames(sizes, files if file else [0] * len(files), frame_size)
            assert got == {i: (w, float(i)) for i, w in enumerate(want)}
        placed = records.with_position(df.drop("pos"), "file", "x")
        order = [r["pos"] for r in placed.orderBy("file", "x").collect()]
        assert order == list(range(900))
        by_file = [n for _, n in sorted(zip(files, sizes), key=lambda z: z[0])] if files != sorted(files) else sizes
        got = [r["frame_id"] for r in frames.assign_frames(placed, frame_size, in_order=True).orderBy("pos").collect()]
        assert got == sequential_frames(by_file, [0] * 900, frame_size)
        assert frames.assign_frames(df.filter("pos < 0"), frame_size).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_byte_offsets(spark):
    got = frames.byte_offsets(corpus(spark, ["alpha", "bravo", "charlie", "delta"])).orderBy("idx").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 6), (6, 12), (12, 20), (20, 26)]


def test_long_records(spark):
    df = corpus(spark, ["ok", "WAY_TOO_LONG", "fin"])
    assert records.limit_length(df, 10).count() == 2
    assert records.limit_length(df, 10, "passthrough").count() == 3
    with pytest.raises(Exception, match="exceeds 10"):
        records.limit_length(df, 10, "fail").collect()
    with pytest.raises(UsageError):
        records.limit_length(df, 10, "hm")
    stats = records.run_stats(df, 10).first()
    assert (stats["records_out"], stats["oversized_skipped"], stats["bytes_out"]) == (2, 1, 7)
    partial = records.run_stats(df, 10, trailing_partial=1).first()
    assert partial["had_trailing_partial"] and partial["bytes_in"] == stats["bytes_in"] - 1 and partial["bytes_out"] == 7


def test_sampling_order(spark):
    df = corpus(spark, ["xxxx", "hello", "world", "xxxx", "more"])
    assert [r["record"] for r in records.sampling_pipeline(df, 1.0, 0, 1.2, None, 2).collect()] == ["hello", "world"]
    assert records.head(df, 0).count() == 0
    kept = records.bernoulli(numbered(spark, 10_000), 0.3, 1).count()
    assert 2700 <= kept <= 3300
    assert records.bernoulli(numbered(spark, 100), 0.0).count() == 0
    assert records.bernoulli(numbered(spark, 100), 1.0).count() == 100
    with pytest.raises(UsageError):
        records.bernoulli(df, 1.5)


def test_epochs_differ_and_resume_is_a_suffix(spark):
    df = numbered(spark, 100)
    rows = shuffle.index_perm_epochs(df, 2, 4).collect()
    a, b = ([r["id"] for r in sorted(rows, key=lambda r: r["out_pos"]) if r["epoch"] == e] for e in (0, 1))
    assert a != b and sorted(a) == sorted(b)
    assert order_of(shuffle.index_perm(df, 4, 1)) == b
    assert order_of(shuffle.resume(shuffle.index_perm(df, 4), 60)) == a[60:]
    assert order_of(shuffle.sample(df, 10, 4)) == a[:10]


def test_verdicts(spark):
    draw = random.Random(2)
    even = ["".join(draw.choices("abcdefghij", k=draw.randint(20, 199))) for _ in range(600)]
    assert analyze.report(frames.assign_frames(corpus(spark, even), 4096)).first()["verdict"] == "SAFE"
    by_length = ["x" * 12] * 4000 + ["x" * 300] * 170
    report = analyze.report(frames.assign_frames(corpus(spark, by_length), 2048))
    assert report.first()["verdict"] == "UNSAFE" and report.first()["length_cv"] > 0.5
    by_letter = ["".join(draw.choices("abcdefghijklm", k=80)) for _ in range(400)] + ["".join(draw.choices("nopqrstuvwxyz", k=80)) for _ in range(400)]
    framed = frames.assign_frames(corpus(spark, by_letter), 256)
    assert analyze.report(framed).first()["kl_max"] > 0.1
    with pytest.raises(UnsafeOrder):
        analyze.report(framed, strict=True)


@pytest.mark.parametrize("text", ["1", '"a"', "null", "[1,2]", '{"a":{"b":[]}}', '{"a":1,"a":2}', '"\\ud800"', "[" * 128 + "]" * 128, '"' + "[" * 500 + '"', "9" * 5_000, "-1." + "3" * 9_000 + "e5"])
def test_valid_json(text):
    assert json_error(text) is None


@pytest.mark.parametrize("text", ["", "{", "[1,]", "01", "1 2", "NaN", "Infinity", "{'a':1}", '"\n"', "tru", "1e", "[" * 129 + "]" * 129, "[" * 10_000])
def test_invalid_json(text):
    assert json_error(text)


@pytest.mark.parametrize(
    "raw, kind, at",
    [
        (b"", "unexpected_eof", 0), (b"{", "bad_string", 1), (b"}", "unexpected", 0), (b"[1,]", "unexpected", 3), (b'{"a" 1}', "unexpected", 5), (b'{"a":1,}', "bad_string", 7), (b"01", "trailing", 1),
        (b"-", "bad_number", 0), (b"[1.]", "bad_number", 1), (b"1e", "bad_number", 0), (b"tru", "bad_literal", 0), (b'"\\x"', "bad_string", 2), (b'"\\u00zz"', "bad_unicode", 5), (b'"\x01"', "bad_string", 1),
        (b'"abc', "unexpected_eof", 4), (b"[" * 129, "too_deep", 128), (b"1 2", "trailing", 2), (b"\xff", "unexpected", 0), (b'["\xff" x', "unexpected", 5),
    ],
)
def test_kinds_of_json_problems(raw, kind, at):
    assert json_problem_of(raw) == (kind, at)
    assert json_error(raw) == f"{kind.replace('_', ' ')} at byte {at}"


@given(st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)), st.integers(0, 200), st.binary(max_size=2))
def test_the_walk_agrees_with_a_parser(value, at, more):
    import json

    raw = json.dumps(value).encode()
    assert json_problem_of(raw) is None
    broken = raw[:at] + more + raw[at + 1 :]
    try:
        json.loads(broken.decode("latin-1"), parse_constant=lambda x: 1 / 0, parse_int=str, parse_float=str)
        good = True
    except (ValueError, ZeroDivisionError):
        good = False
    assert (json_problem_of(broken) is None) == good


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 40)), min_size=1, max_size=60), st.integers(1, 120), st.lists(st.integers(0, 60), max_size=10), st.randoms())
def test_runs_are_composed_in_any_order(records_, frame_size, cuts, draw):
    files, sizes = [str(f) for f, _ in sorted(records_)], [n for _, n in records_]
    cuts = sorted({0, len(files), *(c for c in cuts if c < len(files))})
    runs = []
    for a, b in zip(cuts, cuts[1:]):
        names = sorted(set(files[a:b]))
        runs.append(frames._run_of(np.array(sizes[a:b]), names, [files[a:b].count(x) for x in names], frame_size))
    whole = list(runs)
    while len(whole) > 1:
        i = draw.randrange(len(whole) - 1)
        whole[i : i + 2] = [frames._then(whole[i], whole[i + 1])]
    for state in ((None, 0, 0), (files[0], 5, frame_size - 1)):
        file, frame, held = state
        for f, n in zip(files, sizes):
            if f != file:
                file, frame, held = f, 0, 0
            held += n
            if held >= frame_size:
                frame, held = frame + 1, 0
        assert whole[0].follow(*state) == (file, frame, held)


def test_frames_over_hundreds_of_partitions(spark, monkeypatch):
    draw = random.Random(4)
    sizes = [draw.choice([1, 5, 30, 200]) for _ in range(3_000)]
    files = [f"f{i // 900}" for i in range(3_000)]
    df = spark.createDataFrame([(f, i, n) for i, (f, n) in enumerate(zip(files, sizes))], "file string, pos long, nbytes long")
    monkeypatch.setattr(frames, "RUNS_AT_ONCE", 6)
    dealt = df.repartitionByRange(250, "pos").sortWithinPartitions("pos")
    monkeypatch.setattr(frames, "cut", lambda d: d.checkpoint())
    for size in (64, 5_000):
        got = frames.assign_frames(dealt.checkpoint(), size, file="file", in_order=True)
        assert {r["pos"]: r["frame_id"] for r in got.collect()} == dict(enumerate(sequential_frames(sizes, files, size)))


def test_ranks_are_held_against_the_input(spark):
    ids = spark.range(100)
    mine = lambda r: ids.filter(F.col("id") % 3 == r)
    assert verify.ranks_cover(ids, [mine(r) for r in range(3)]).first().asDict() == {"n_rows": 100, "covered": 100, "overlap": 0, "foreign": 0}
    wrong = verify.ranks_cover(ids, [mine(0), mine(0).filter("id < 9"), spark.range(200, 205)]).first().asDict()
    assert wrong == {"n_rows": 100, "covered": 34, "overlap": 3, "foreign": 8}


@pytest.mark.parametrize("active", [1, 3, 8])
def test_interleaving_is_the_sequential_schedule(spark, active):
    import heapq

    from millrace.functions.prf import prf_unit

    draw = random.Random(active)
    frame_of = [f for f in range(23) for _ in range(draw.choice([1, 4, 30]))]
    df = spark.createDataFrame(list(enumerate(frame_of)), "id long, frame_id long")
    rows = shuffle.interleaved(df, active, 5).withColumn("u", prf_unit(5, "stride", 0, "frame_id", "id")).collect()
    frames_ = {}
    for r in rows:
        frames_.setdefault(r["frame_pos"], []).append((r["rec_pos"], r["u"], r["id"]))
    waiting = [sorted(frames_[p]) for p in sorted(frames_)]
    assert sorted(frames_) == list(range(len(frames_)))
    open_, got = [], []

    def begin(p, at, lasts):
        if p < len(waiting):
            own = waiting[p]
            heapq.heappush(open_, (at + (own[0][0] + own[0][1]) / len(own) * lasts, p, 0, at, lasts))

    for p in range(active):
        begin(p, 0, (p + 1) / active)
    while open_:
        _, p, k, at, lasts = heapq.heappop(open_)
        assert len(open_) < active
        own = waiting[p]
        got.append(own[k][2])
        if k + 1 < len(own):
            heapq.heappush(open_, (at + (own[k + 1][0] + own[k + 1][1]) / len(own) * lasts, p, k + 1, at, lasts))
        else:
            begin(p + active, at + lasts, 1)
    assert [r["id"] for r in sorted(rows, key=lambda r: r["out_pos"])] == got and sorted(r["out_pos"] for r in rows) == list(range(len(rows)))


def test_drift_of_lengths_and_first_words(spark):
    draw = random.Random(7)
    even = [f"{draw.choice('abc')} " + "x" * draw.randint(5, 60) for _ in range(2_000)]
    by_length = sorted(even, key=len)
    by_word = sorted(even)
    found = {}
    for name, texts in (("even", even), ("length", by_length), ("word", by_word)):
        framed = frames.assign_frames(corpus(spark, texts), 4_096).cache()
        exact, sketched = (analyze.drift(framed, 8, accuracy=a).first() for a in (None, 10_000))
        assert math.isclose(exact["length_drift_max"], sketched["length_drift_max"], rel_tol=0.1) and exact["prefix_kl_max"] == sketched["prefix_kl_max"]
        found[name] = exact
    assert found["length"]["length_drift_max"] > 4 * found["even"]["length_drift_max"] and found["word"]["prefix_kl_max"] > 10 * found["even"]["prefix_kl_max"]
    with_tabs = frames.assign_frames(corpus(spark, ["\t ", "", "one two"]), 10**6)
    assert analyze.drift(with_tabs).first()["prefix_kl_max"] == 0


def test_entropy():
    assert entropy_of(b"") == 0 and entropy_of(b"aaaa") == 0
    assert math.isclose(entropy_of(bytes(range(256))), math.log(256))


@given(st.integers(0, 10**9))
def test_sizes(n):
    assert parse_size(str(n)) == n and parse_size(f"{n}k") == 1000 * n and parse_size(f"{n} KiB") == 1024 * n
    assert humanize(n)


def test_size_errors():
    assert parse_size("1.5Ki") == 1536 and parse_size("2MiB") == 2 << 20
    for bad in ("", "x", "1zb", "-1"):
        with pytest.raises(ValueError):
            parse_size(bad)
