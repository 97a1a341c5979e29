import math

import numpy as np
import pytest

from millrace.llm import ann, exact_topk


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.float32(draw.normal(size=16) / 4)]) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # a third are copies of one
    rows += [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 14), (2003, [float("nan")] * 16), (2004, [math.inf] * 16), (2020, [0.0] * 16), (None, [0.5] * 16), (50, rows[50][1])]
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, id string, score double").repartition(4).cache()


def valid(df, zero):
    out = {}
    for r in df.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v and None not in v and np.isfinite(v).all() and (zero or any(v)):
            out[r["vec_id"]] = np.array(v, dtype=float)
    return out


def brute(table, k, every):
    ids = np.array(sorted(table))
    matrix = np.array([table[i] for i in ids])
    out = {}
    for i in ids[ids % every == 0]:
        s = matrix @ table[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_exact_top_k(vectors):
    table = {i: np.floor(v * 256) for i, v in valid(vectors, True).items()}
    want = brute(table, 5, 50)
    got = {}
    for r in exact_topk.top_k(vectors, 5, 50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {q: [(i, int(s)) for i, s in hits] for q, hits in want.items()}


def test_bounds_stop_early_and_lose_nothing():
    draw = np.random.default_rng(9)
    centres = draw.normal(size=(20, 8)) * 400
    v = np.floor(centres[draw.integers(0, 20, 4_000)] + draw.normal(size=(4_000, 8)) * 9).astype(np.int64)
    pivots = v[:32]
    near, norms = exact_topk.pivot_distances(v, pivots), (v.astype(float) ** 2).sum(axis=1)
    for q in range(5):
        best = exact_topk.best_in_block(v[q], near[q], v, near, norms, np.arange(4_001), np.arange(4_000), 6)
        s = v @ v[q]
        assert best.ids.tolist() == np.lexsort((np.arange(4_000), -s))[:6].tolist()


def test_nearest_found(vectors):
    table = valid(vectors, False)
    want = brute(table, 20, 20)
    got = {}
    for r in ann.nearest(vectors, 20, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = []
    for q, rows in got.items():
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in [r[1] for r in rows]
        assert [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        assert all(math.isclose(s, float(table[q] @ table[i]), rel_tol=1e-12, abs_tol=1e-12) for _, i, s in rows)
        least = want[q][-1][1]
        hits.append(np.mean([s >= least - 1e-9 for _, _, s in rows]))
    assert np.mean(hits) >= 0.9


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 48))
    assert np.allclose((ann.rotate(x, 0, 0) ** 2).sum(1), (x**2).sum(1))
    for parts in (1, 2, 3):
        assert (ann.probing_order(x, 1, parts, 7)[:, 0] == ann.own_buckets(x, 1, parts)).all()


def test_probing_orders_are_those_of_all_tuples(monkeypatch):
    x = np.random.default_rng(2).normal(size=(9, 5))
    monkeypatch.setattr(ann, "ROOM", 100)
    for parts, most in ((1, 16), (2, 40), (3, 25)):
        sums = np.zeros((9, 1))
        for part in range(parts):
            sums = (sums[:, :, None] + ann.axis_scores(x, 2, part)[:, None, :]).reshape(9, -1)
        got = ann.probing_order(x, 2, parts, most)
        want = -np.sort(-sums, axis=1)[:, :most]
        assert np.allclose(np.take_along_axis(sums, got, axis=1), want) and all(len(set(r)) == len(r) for r in got.tolist())
    assert ann.bucket_axes(1_000, 64) == 1 and ann.bucket_axes(10**7, 64) == 2 and ann.bucket_axes(10**11, 64) == 4


def test_large_tables_take_several_axes_a_bucket(vectors, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_ROWS", 4)
    table = valid(vectors, False)
    want = brute(table, 20, 20)
    for most in (4_096, 8):  # with eight probes a single axis has to do
        monkeypatch.setattr(ann, "MOST_PROBES", most)
        monkeypatch.setattr(ann, "PIECE_ROWS", 16)
        if most == 8:
            monkeypatch.setattr(ann, "calibrated_probes", lambda *a, f=ann.calibrated_probes: f(*a) if a[3] > 1 else 32)
        found = {}
        for r in ann.nearest(vectors, 20, 20).collect():
            found.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert np.mean([len(found[q] & {i for i, _ in hits}) / 20 for q, hits in want.items()]) >= 0.9


def test_scores_dont_depend_on_blocks(vectors, monkeypatch):
    rows = lambda: {(r["query_id"], r["vec_id"]): r["score"] for r in ann.nearest(vectors, 20, 20).collect()}
    one = rows()
    monkeypatch.setattr(ann, "PIECE_ROWS", 7)
    two = rows()
    assert len(set(one) & set(two)) > 0.9 * len(one) and all(one[x] == two[x] for x in set(one) & set(two))


def test_pivots_are_far_apart_and_blocks_are_left_out(spark, monkeypatch):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 8)) * 3
    v = np.float32(centres[draw.integers(0, 12, 3_000)] + draw.normal(size=(3_000, 8)) * 0.05)
    pivots = exact_topk.far_apart(exact_topk.quantised(v.astype(float)), 12)
    near = exact_topk.pivot_distances(pivots, exact_topk.quantised(centres))
    assert len({int(x) for x in near.argmin(axis=1)}) == 12
    monkeypatch.setattr(exact_topk, "VECTORS_A_BLOCK", 100)
    monkeypatch.setattr(exact_topk, "SAMPLE", 300)
    monkeypatch.setattr(exact_topk, "QUERIES_A_BLOCK", 16)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    sent = []
    plain = exact_topk.ranked
    monkeypatch.setattr(exact_topk, "ranked", lambda found, *a: sent.append(found.count()) or plain(found, *a))
    got = {}
    for r in exact_topk.top_k(df, 5, 50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute({i: np.floor(x.astype(float) * 256) for i, x in enumerate(v)}, 5, 50)
    assert got == {q: [(i, int(s)) for i, s in hits] for q, hits in want.items()}
    assert sent[0] < 60 * 30 * 6 / 3  # of 60 queries to some 30 blocks


def test_ids_with_many_vectors_leave_room_for_others(spark):
    draw = np.random.default_rng(12)
    query = np.float32(draw.normal(size=8))
    rows = [(0, query), (0, query * 2), (20, query), (50, -query)]
    rows += [(7, query * 3 + np.float32(draw.normal(size=8) * 0.01)) for _ in range(12)]
    rows += [(100 + i, np.float32(draw.normal(size=8))) for i in range(29)]
    rows += rows[:9]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "vec_id long, embedding array<float>").repartition(3)
    for k, every, search, form in ((5, 50, exact_topk.top_k, lambda x: np.floor(x * 256)), (20, 20, ann.nearest, lambda x: x)):
        own: dict = {}
        for i, x in rows:
            own.setdefault(i, []).append(form(x.astype(float)))
        got = {}
        for r in search(df, k, every).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        for q in (i for i in own if i % every == 0):
            best = sorted((-max(a @ b for a in own[q] for b in own[i]), i) for i in own if i != q)[:k]
            assert len({i for i, _ in got[q]}) == len(got[q]) == k
            assert all(np.isclose(s, max(a @ b for a in own[q] for b in own[i])) for i, s in got[q])
            if search is exact_topk.top_k:
                assert [i for i, _ in got[q]] == [i for _, i in best]
            else:
                assert got[q][0][0] == best[0][1] and len({i for i, _ in got[q]} & {i for _, i in best}) >= 0.9 * k


def test_ties_go_to_smaller_ids(spark):
    draw = np.random.default_rng(7)
    rows = [(i, [1.0, 0.0, 0.0, float(draw.integers(0, 2))]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    want = brute(valid(df, False), 20, 20)
    got = {}
    for r in ann.nearest(df, 20, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {q: [(i, float(s)) for i, s in hits] for q, hits in want.items()}

def test_empty_and_tiny_tables(spark, vectors):
    none = vectors.filter("false")
    assert exact_topk.top_k(none, 5, 50).collect() == [] and ann.nearest(none, 20, 20).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (40, [1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(two, 20, 20).collect()] == [(0, 1)]
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in exact_topk.top_k(two, 5, 50).collect()] == [(0, 1, 256 * 128)]
