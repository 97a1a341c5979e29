import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import byte_bpe, packing, token_counts, token_files, tokens
from millrace.llm.merging import HEAP_FROM, merge

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = Tokenizer.from_file(WORDS)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PIECES = ["a", "The", " the", "é", "ß", "İ", "Σ", "日", " ", "  ", "\n", "\t", "\x1c", "'", "'s", "'ll", "1", "²", "!", "...", "<|endoftext|>", "́", "ﬁ", "😀", "ing", "tion"]
texts = st.lists(st.sampled_from(PIECES) | st.characters(exclude_categories=["Cs", "Cn"]), max_size=25).map("".join)


def word_ids(text, *end):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, *end], dtype="<u4")


@settings(max_examples=400, deadline=None)
@given(texts)
def test_word_ids_and_counts_are_the_librarys(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.chunk_encoder(WORDS).encode(text), "<u4").tolist() == want
    counter = token_counts.TokenCounter(WORDS, token_counts.prove_whole_tokens(WORDS)) if not hasattr(test_word_ids_and_counts_are_the_librarys, "c") else test_word_ids_and_counts_are_the_librarys.c
    test_word_ids_and_counts_are_the_librarys.c = counter
    assert counter.count(text) == len(want)


@settings(max_examples=600, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=30))
def test_chunks_of_letters_digits_and_marks_are_the_librarys(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.chunk_encoder(WORDS).encode(text), "<u4").tolist() == want


def test_what_is_remembered_is_bounded_by_bytes(monkeypatch):
    from millrace.llm.merging import Remembered

    class Squares(Remembered):
        worked = 0

        def work(self, key):
            self.worked += 1
            return key * 2

    monkeypatch.setattr(Remembered, "room", 20_000)
    memory = Squares()
    names = [f"name {i}" for i in range(2_000)]
    assert [memory[n] for n in names] == [n * 2 for n in names] and memory["x" * 100] == "x" * 200
    assert len(memory) + len(memory.old) < 2 * 20_000 / memory.beside and "x" * 100 not in memory
    before = memory.worked
    assert [memory[n] for n in names[-50:]] == [n * 2 for n in names[-50:]] and memory.worked == before


def test_texts_of_megabytes(spark, tmp_path):
    draw = random.Random(6)
    long_one = " ".join(draw.choice(["word", "Other,", "x1", "\n", "ünï", "don't"]) + str(draw.randrange(50)) for _ in range(600_000))
    rows = [(1, "short one"), (2, long_one), (3, "a" * 3_000_000), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    want = {i: word_ids(t, 2) for i, t in rows}
    token_files.write_token_files(df, str(tmp_path / "out"), WORDS, 2)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.token_index(spark, str(tmp_path / "out")).collect()}
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, WORDS).collect()}
    assert counts == {i: len(x) - 1 for i, x in want.items()}
    pieces = packing.pack(df, WORDS, 4096, 2).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in pieces} == {i: len(x) for i, x in want.items()}


def test_slices_by_bytes():
    import pyarrow as pa

    from millrace.llm.common import in_byte_slices

    texts = ["a" * 10, None, "", "b" * 50, "c", "d" * 9, "é" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for most in (1, 10, 20, 1000):
        slices = [s.column(0).to_pylist() for s in in_byte_slices([batch, batch.slice(0, 0)], "text", most)]
        assert [t for s in slices for t in s] == texts
        assert all(len(s) == 1 or sum(len((t or "").encode()) for t in s) <= most for s in slices)


def test_texts_in_any_script_are_counted_without_the_librarys_encoder():
    counter = token_counts.TokenCounter(WORDS, token_counts.prove_whole_tokens(WORDS))
    draw = random.Random(12)
    scripts = [range(0x400, 0x500), range(0x370, 0x3FF), range(0x5D0, 0x5EB), range(0x4E00, 0x4F00), range(0x1F600, 0x1F640), range(0x2010, 0x2030), range(0x300, 0x340), range(0x1C, 0x20), range(0x41, 0x7B)]
    made = ["".join(chr(draw.choice(draw.choice(scripts))) for _ in range(draw.randrange(1, 60))) for _ in range(3_000)]
    made += [f"{t} word. {t}" for t in ("Привет", "κόσμε ΣΑΣ", "中文 字", "“quoted” it’s", "ﬁne ½", "😀😀")]
    want = [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in made]
    counter.library = type("Cutter", (), {"normalizer": counter.library.normalizer, "pre_tokenizer": counter.library.pre_tokenizer})()
    assert [counter.count(t) for t in made] == want


@settings(max_examples=400, deadline=None)
@given(texts)
def test_byte_ids_are_tiktokens_and_decode(text):
    encoder = byte_bpe.byte_encoder(BYTES)
    ids = np.frombuffer(encoder.encode_all([text])[0], "<u4")
    assert ids.tolist() == TIKTOKEN.encode_ordinary(text)
    assert encoder.decode(ids, encoder.offsets(ids)) == text.encode()


def test_long_texts_are_cut_where_tokens_end(monkeypatch):
    draw = random.Random(4)
    text = "".join(draw.choice(PIECES) + draw.choice(["", " word word "]) for _ in range(3_000))
    monkeypatch.setattr(byte_bpe, "SEGMENT", 200)
    assert len(byte_bpe.segments(text)) > 20 and "".join(byte_bpe.segments(text)) == text
    assert np.frombuffer(byte_bpe.byte_encoder(BYTES).encode_all([text])[0], "<u4").tolist() == TIKTOKEN.encode_ordinary(text)


def test_heap_and_list_merge_alike():
    draw = random.Random(5)
    for _ in range(30):
        raw = bytes(draw.choices(b"thenai ", k=HEAP_FROM + 20))
        assert b"".join(parts := merge([raw[i : i + 1] for i in range(len(raw))], RANKS)) == raw
        assert [RANKS[p] for p in parts] == TIKTOKEN._encode_single_piece(raw)


def test_proofs():
    whole = set(token_counts.prove_whole_tokens(WORDS))
    assert "the" in whole and len(whole) > 10_000
    assert all(len(LIBRARY.encode(w, add_special_tokens=False).ids) == 1 for w in sorted(whole)[::97])


def test_counts_of_odd_documents(odd, none):
    got = token_counts.token_counts(odd, WORDS, limit=10).collect()
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0), len((r["text"] or "").encode()), len(word_ids(r["text"]))) for r in odd.collect())
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 10) for r in got)
    assert token_counts.token_counts(none, WORDS).collect() == []


def test_byte_round_trip_of_odd_documents(odd, none):
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    want = sorted((len(ids := TIKTOKEN.encode_ordinary(r["text"] or "")), digest(np.array(ids, "<u4").tobytes()), digest((r["text"] or "").encode())) for r in odd.collect())
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.round_trip(odd, BYTES).collect()) == want
    encoded = byte_bpe.encode(odd, BYTES)
    for r in encoded.collect():
        assert len(r["offsets"]) == len(r["ids"]) + 1 and r["offsets"][0] == 0
    decoded = byte_bpe.decode(encoded, BYTES).collect()
    assert sorted(digest(bytes(r["decoded"])) for r in decoded) == sorted(w[2] for w in want)
    assert byte_bpe.round_trip(none, BYTES).collect() == [] and byte_bpe.decode(byte_bpe.encode(none, BYTES), BYTES).collect() == []


def test_documents_are_decoded_by_their_offsets():
    encoder = byte_bpe.byte_encoder(BYTES)
    text = "naïve café, 3 o'clock"
    raw = encoder.encode_all([text])[0]
    ids = np.frombuffer(raw, "<u4")
    offsets = encoder.offsets(ids)
    assert [encoder.words[i] for i in ids] == [text.encode()[a:b] for a, b in zip(offsets, offsets[1:])] and offsets[-1] == len(text.encode())
    assert encoder.digests(raw) == (len(ids), *(hashlib.sha256(x).hexdigest() for x in (raw, text.encode(), offsets.astype("<u8").tobytes())))
    for wrong in (offsets + 1, np.append(offsets[:-1], offsets[-1] + 1), np.append(0, np.roll(offsets[1:], 1))):
        with pytest.raises(ValueError, match="disagree"):
            encoder.decode(ids, wrong)


def test_token_files(spark, odd, none, tmp_path):
    out = str(tmp_path / "ids")
    token_files.write_token_files(odd, out, WORDS, 2, row_group_bytes=64 << 10, page_rows=4)
    got = token_files.token_index(spark, out).collect()
    assert len(got) == odd.count()
    want = sorted((len(word_ids(r["text"], 2)), zlib.crc32(word_ids(r["text"], 2).tobytes())) for r in odd.collect())
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *[r["n_tokens"] for r in ordered]])[:-1].tolist()
    ids = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in ordered]
    assert ids == sorted(ids)
    some = token_files.read_token_files(spark, out, first=3, last=6).collect()
    assert {r["doc_id"] for r in some} == {3, 4, 6} and len(some) == 4
    assert "ids" not in token_files.read_token_files(spark, out, with_ids=False).columns
    part = next((tmp_path / "ids").glob("part-*.parquet"))
    columns = {pq.ParquetFile(part).metadata.row_group(0).column(i).path_in_schema: pq.ParquetFile(part).metadata.row_group(0).column(i) for i in range(4)}
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings) and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    assert columns["n_tokens"].has_offset_index and columns["n_tokens"].has_column_index
    token_files.write_token_files(none, str(tmp_path / "none"), WORDS, 2)
    assert token_files.token_index(spark, str(tmp_path / "none")).collect() == []


def test_files_follow_their_ids_whatever_they_are_called(spark, tmp_path, monkeypatch):
    ids = [None] * 40 + [5] * 90 + list(range(6, 60))
    df = spark.createDataFrame([(i, f"text {k} {'x ' * (k % 7)}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        token_files.write_token_files(df, str(tmp_path / "a"), WORDS, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "a").glob("part-*.parquet"))
    want = [(r["doc_id"], r["n_tokens"]) for p in parts for r in pq.read_table(p, columns=["doc_id", "n_tokens"]).to_pylist()]
    assert len(parts) > 5
    for k, p in enumerate(reversed(parts)):
        p.rename(p.with_name(f"re named%20-{k:03d}.parquet"))
    index = token_files.token_index(spark, str(tmp_path / "a"))
    assert "Join" not in index._jdf.queryExecution().toString()  # documents are neither joined nor broadcast
    got = sorted(index.collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == want
    assert [r["start"] for r in got] == np.cumsum([0, *[n for _, n in want]])[:-1].tolist()
    monkeypatch.setattr(token_files, "PLAIN_IDS", ())
    by_spark = token_files.token_index(spark, str(tmp_path / "a"))
    assert by_spark.columns == index.columns and sorted(by_spark.collect(), key=lambda r: r["start"]) == got


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(odd, none, capacity):
    rows = packing.pack(odd, WORDS, capacity, 1).collect()
    want = []
    for r in odd.collect():
        ids = word_ids(r["text"], 1)
        want += [(i // capacity, i, len(p), zlib.crc32(p.tobytes())) for i in range(0, len(ids), capacity) for p in [ids[i : i + capacity]]]
    assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= -(-sum(w[2] for w in want) // capacity) + 2
    assert packing.pack(none, WORDS, capacity, 1).collect() == []


def lengths_of(kind):
    draw = np.random.default_rng(6)
    return {
        "many": draw.lognormal(5.5, 1, 20_000),
        "millions": draw.lognormal(5.5, 1, 2_000_000),
        "few": draw.lognormal(5.5, 1, 30),
        "large": draw.integers(2100, 4097, 500),
        "short": draw.integers(1, 40, 100_000),
        "equal": np.full(999, 700),
        "one": np.full(1, 5),
    }[kind]


@pytest.mark.parametrize("kind", ["many", "millions", "few", "large", "short", "equal", "one"])
def test_plans_use_each_piece_once(kind):
    histogram = np.bincount(np.clip(lengths_of(kind), 1, 4096).astype(int), minlength=4097)
    packed = packing.plan(histogram, 4096)
    used = np.zeros(4097, dtype=np.int64)
    for pattern, times in packed:
        assert sum(x * n for x, n in pattern) <= 4096
        for x, n in pattern:
            used[x] += times * n
    assert (used == histogram).all()
    n = sum(t for _, t in packed)
    total = int((histogram * np.arange(4097)).sum())
    least = max(-(-total // 4096), int(histogram[2049:].sum()))
    assert n <= (200 if kind == "equal" else least * 1.01 + 1)
    place = packing.Placement(packed, 4096)
    assert place.n_sequences == n
    if kind != "millions":
        lengths = np.repeat(np.arange(4097), histogram)
        ranks = np.concatenate([np.arange(m) for m in histogram])
        sequence, offset = place(lengths, ranks)
        order = np.lexsort((offset, sequence))
        first = np.append(True, np.diff(sequence[order]) > 0)
        assert (np.where(first, 0, np.roll(offset[order] + lengths[order], 1)) == offset[order]).all()


@pytest.mark.parametrize("kind", ["many", "millions", "short"])
def test_fitted_patterns_place_nearly_all(kind):
    histogram = np.bincount(np.clip(lengths_of(kind), 1, 4096).astype(int), minlength=4097)
    _, left = packing.by_patterns(histogram, 4096)
    assert left[:4096].sum() <= 0.05 * histogram[1:4096].sum()
    patterns = packing.enumerate_patterns(histogram, 4096, 16_384, 0)
    counts = packing.fit_counts(patterns, histogram.astype(float))
    used = np.bincount(patterns.length, counts[patterns.pattern] * patterns.pieces, 4097)
    assert np.abs(used - histogram)[1:4096].sum() <= 0.2 * histogram[1:4096].sum()
