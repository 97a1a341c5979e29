"""The registered queries of the ten operators against their SQL, the libraries or brute force, on the driver's tables."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import SF, oracle, rows_of
from tokenizers import Tokenizer

from millrace.llm import queries
from millrace.llm.common import table

WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}


def word_ids(text, *end):
    return np.array([*WORDS.encode(text, add_special_tokens=False).ids, *end], dtype="<u4")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(oracle(queries.ORACLE_SQL[name]))


def test_small_shards_are_split(spark):
    assert queries.sharding_of_small_shards(spark, SF).selectExpr("min(depth) AS d").first()["d"] > 0


def test_op2(spark, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = {i: len(w) for w, i in ranks.items()}
    for r in queries.op2_byte_bpe(spark, SF).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        offsets = np.cumsum([0, *[lengths[i] for i in ids]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["offsets_sha256"] == hashlib.sha256(offsets.astype("<u8").tobytes()).hexdigest()


def test_op7(spark, texts):
    start, want = 0, []
    for i in sorted(texts):
        ids = word_ids(texts[i], 2)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in queries.op7_token_files(spark, SF).collect()) == want


def test_op8(spark, texts):
    want = []
    for i, t in texts.items():
        ids = word_ids(t, 1)
        want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    rows = queries.op8_pattern_packing(spark, SF).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()] and sum(places[-1]) <= 4096
    assert len(by) <= -(-sum(w[3] for w in want) // 4096) * 1.01 + 1


def test_op10(spark, texts):
    for r in queries.op10_token_counts(spark, SF).collect():
        n = len(word_ids(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 2048)


def test_op5(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in table(spark, SF, "embeddings").collect()}
    ids = np.array(sorted(rows))
    matrix = np.array([rows[i] for i in ids])
    found: dict[int, list] = {}
    for r in queries.op5_cross_polytope(spark, SF).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == [int(i) for i in ids if i % 20 == 0]
    recall = []
    for q, hits in found.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21)) and [(-h[2], h[1]) for h in hits] == sorted((-h[2], h[1]) for h in hits)
        assert all(np.isclose(h[2], rows[h[1]] @ rows[q], rtol=1e-12, atol=1e-14) for h in hits)
        scores = matrix @ rows[q]
        scores[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        recall.append(len(best & {h[1] for h in hits}) / 20)
    assert np.mean(recall) >= 0.9
