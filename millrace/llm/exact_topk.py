"""Exact largest inner products by pivot-table elimination.

Distances from every vector to some dozens of pivots, far apart from each other
in a bounded sample, are computed once. For a query q and a vector v, the
largest |d(q, p) - d(v, p)| over the pivots p bounds d(q, v) from below, and so
the inner product (|q|² + |v|² - d²) / 2 from above. The sample also gives each
query a score that its k-th best reaches at least.

Vectors lie in blocks by their nearest pivot. A block's least and largest
distance to each pivot bounds all its products with a query, which only goes to
blocks that can hold something better than what it has. There candidates are
evaluated in descending order of their bound until it falls below the query's
k-th score; so no vector that could be among the nearest is left out. Blocks of
queries meet blocks of vectors, and only the best rows of a query leave a block.
Where vectors have no structure, as random ones in many dimensions, the bounds
exclude little, and every query goes to every block.

Components become floor(256 x) and scores are exact integers, for components
below 2^20 in size. See ``vectors`` for nulls, copies and repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import Best, OfIds, distinct_vectors, expand, ranked, unpack, valid_vectors

PIVOTS = 32
SAMPLE = 2_048
VECTORS_A_BLOCK = 8_192
#: Blocks grow once there would be more: their bounds, some hundred bytes each, are broadcast.
MOST_BLOCKS = 16_384
QUERIES_A_BLOCK = 16_384
AT_ONCE = 512
#: Integers up to here are exact as doubles.
EXACT = 2.0**53
#: Distances are rounded doubles of exact squares; bounds are raised by so much.
MARGIN = 1e-6


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 256).astype("<i8")


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    v, p = vectors.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * (v @ p.T), 0))


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of a sample, each the farthest from those before it."""
    picked = [int(np.argmax((sample.astype(np.float64) ** 2).sum(axis=1)))]
    near = pivot_distances(sample, sample[picked])[:, 0]
    while len(picked) < min(n, len(sample)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, pivot_distances(sample, sample[picked[-1:]])[:, 0])
    return sample[picked]


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of doubles with a query, which hold integers."""
    largest = np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * max(1, len(query))
    if largest < EXACT:
        return (vectors @ query).astype(np.int64)
    return vectors.astype(np.int64) @ query.astype(np.int64)


def upper_bound(squares: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The largest product of vectors whose squared lengths sum to ``squares`` and that are ``apart`` at least."""
    bound = (squares - apart * apart) / 2
    return bound + np.abs(bound) * MARGIN + 1


def best_in_block(query: np.ndarray, to_pivots: np.ndarray, vectors: np.ndarray, distances: np.ndarray, norms: np.ndarray, id_offsets: np.ndarray, id_values: np.ndarray, room: int, least: float = -np.inf) -> Best:
    """The best rows of a block among those whose score is ``least`` or more."""
    best = Best(room)
    query = query.astype(np.float64)
    apart = np.abs(distances - to_pivots).max(axis=1) if distances.shape[1] else np.zeros(len(vectors))
    bound = upper_bound(norms + float(query @ query), apart)
    order = np.flatnonzero(bound >= least)
    order = order[np.argsort(-bound[order], kind="stable")]
    for at in range(0, len(order), AT_ONCE):
        worst = max(least, best.worst() if best.worst() is not None else -np.inf)
        if bound[order[at]] < worst:
            break
        hits = order[at : at + AT_ONCE]
        scores = products(vectors[hits], query)
        fine = scores >= worst
        if fine.any():
            best.add(*expand(hits[fine], scores[fine], id_offsets, id_values))
    return best


def top_k(df: DataFrame, k: int, every: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long) of queries whose id is divisible by ``every``, against all other rows."""
    context = df.sparkSession.sparkContext
    rows = cut(valid_vectors(df, id_col, vector_col, quantised, zero=True))
    distinct = cut(distinct_vectors(rows, k))
    queries = rows.filter(F.col("id") % every == 0).withColumn("qkey", F.md5("v"))
    asked = queries.groupBy("dim", "v", "qkey").agg(F.count("*").alias("n")).drop("n")
    samples: dict[int, tuple[list[bytes], list[int]]] = {}
    for r in distinct.select("dim", "v", F.col("ids")[0].alias("id")).orderBy(F.md5("v")).limit(SAMPLE).collect():
        raw, ids = samples.setdefault(r["dim"], ([], []))
        raw.append(bytes(r["v"]))
        ids.append(r["id"])
    sampled = {d: (np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, d).astype(np.float64), OfIds(np.array(ids))) for d, (raw, ids) in samples.items()}
    # dimensions that the sample lacks have one cell, no pivots, and bounds from lengths alone
    shared = context.broadcast({d: (far_apart(x, PIVOTS), x, ids) for d, (x, ids) in sampled.items()})

    def measure(batches):
        for batch in batches:
            near, cell = [], []
            for dim, raw in zip(batch.column("dim").to_pylist(), batch.column("v").to_pylist()):
                own = shared.value.get(dim)
                distances = pivot_distances(np.frombuffer(raw, dtype="<i8")[None, :], own[0])[0] if own else np.zeros(0)
                near.append(distances.astype("<f8").tobytes())
                cell.append(int(distances.argmin()) if own else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.binary()), pa.array(cell, pa.int32())], names=[*batch.schema.names, "to_pivots", "cell"])

    vectors = cut(distinct.mapInArrow(measure, "dim int, v binary, ids array<long>, to_pivots binary, cell int"))
    sizes = vectors.groupBy("dim", "cell").agg(F.count("*").alias("n"))  # a row a pivot
    total = vectors.count()
    a_block = max(VECTORS_A_BLOCK, -(-total // MOST_BLOCKS))
    piece = F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / a_block)).cast("int")
    vectors = vectors.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("block", F.concat_ws(":", "cell", piece)).drop("n", "cell")

    def bounds(batches):
        for batch in batches:
            out: dict[tuple[int, str], list] = {}
            for dim, block, raw, near in zip(*(batch.column(c).to_pylist() for c in ("dim", "block", "v", "to_pivots"))):
                x = np.frombuffer(raw, dtype="<i8").astype(np.float64)
                d = np.frombuffer(near, dtype="<f8")
                held = out.setdefault((dim, block), [d.copy(), d.copy(), 0.0])
                np.minimum(held[0], d, out=held[0])
                np.maximum(held[1], d, out=held[1])
                held[2] = max(held[2], float(x @ x))
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in out], pa.int32()), pa.array([b for _, b in out], pa.string()), *(pa.array([h[i].tolist() for h in out.values()], pa.list_(pa.float64())) for i in (0, 1)), pa.array([h[2] for h in out.values()], pa.float64())],
                names=["dim", "block", "low", "high", "square"],
            )

    partial = vectors.select("dim", "block", "v", "to_pivots").mapInArrow(bounds, "dim int, block string, low array<double>, high array<double>, square double")
    each = lambda f, c: F.array(*(f(F.try_element_at(c, F.lit(i + 1))) for i in range(PIVOTS)))
    about: dict[int, list] = {}
    for r in partial.groupBy("dim", "block").agg(each(F.min, F.col("low")).alias("low"), each(F.max, F.col("high")).alias("high"), F.max("square").alias("square")).collect():  # MOST_BLOCKS and a few
        about.setdefault(r["dim"], []).append((r["block"], [x for x in r["low"] if x is not None], [x for x in r["high"] if x is not None], r["square"]))
    blocks = context.broadcast({d: ([x[0] for x in own], *(np.array([x[i] for x in own], dtype=np.float64).reshape(len(own), -1) for i in (1, 2)), np.array([x[3] for x in own])) for d, own in about.items()})

    def send(batches):
        """Each query to the blocks that can hold something for it, with the score that it is sure of."""
        for batch in batches:
            taken, names, sure = [], [], []
            for i, (dim, raw, near) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dim", "v", "to_pivots")))):
                x, d = np.frombuffer(raw, dtype="<i8").astype(np.float64), np.frombuffer(near, dtype="<f8")
                own = shared.value.get(dim)
                reached = own[2].nth(products(own[1], x), k) if own else None  # by k other ids and perhaps the query's own
                least = -np.inf if reached is None else float(reached)
                block, low, high, square = blocks.value[dim]
                apart = np.maximum(np.maximum(d - high, low - d), 0).max(axis=1, initial=0)
                for b in np.flatnonzero(upper_bound(square + float(x @ x), apart) >= least).tolist():
                    taken.append(i)
                    names.append(block[b])
                    sure.append(least)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(taken, pa.int64())) for c in batch.columns[:4]), pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=[*batch.schema.names[:4], "block", "least"])

    query_blocks = max(1, -(-asked.count() // QUERIES_A_BLOCK))
    asked = asked.mapInArrow(measure, "dim int, v binary, qkey string, to_pivots binary, cell int").mapInArrow(send, "dim int, v binary, qkey string, to_pivots binary, block string, least double")
    asked = cut(asked.withColumn("query_block", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(query_blocks)).cast("int")))
    going = asked.select("dim", "block", "query_block").distinct().toDF("dim", "block", "query_block")
    vectors = vectors.join(going, ["dim", "block"])  # only blocks that a query goes to, and only to its block

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids, scores = [], [], []
        if left.num_rows and right.num_rows:
            matrix, lists = unpack(left.column("v"), "<i8").astype(np.float64), left.column("ids").combine_chunks()
            near, norms = unpack(left.column("to_pivots"), "<f8"), (matrix**2).sum(axis=1)
            offsets, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            for key, raw, to_pivots, least in zip(*(right.column(c).to_pylist() for c in ("qkey", "v", "to_pivots", "least"))):
                best = best_in_block(np.frombuffer(raw, dtype="<i8"), np.frombuffer(to_pivots, dtype="<f8"), matrix, near, norms, offsets, values, k + 1, least)
                if best.scores is not None:
                    keys += [key] * len(best.ids)
                    ids.append(best.ids)
                    scores.append(best.scores)
        flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"qkey": pa.array(keys, pa.string()), "id": flat(ids), "score": flat(scores)})

    by = ["dim", "block", "query_block"]
    found = vectors.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(meet, "qkey string, id long, score long")
    return ranked(found, queries, k, "long")
