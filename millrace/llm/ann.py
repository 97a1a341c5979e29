"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (random signs and a fast Hadamard transform, three times)
turns a unit vector; its bucket in a table is the signed axis that it is
nearest to, or a tuple of such axes of several rotations for large tables. A
query also probes the buckets of the axes that are next nearest. Candidates of
all tables are reranked by exact inner products, summed in an order that doesn't
depend on what else is in their block.

How many buckets a query probes is measured, not guessed: for a bounded sample
of queries, one pass over all vectors finds the true neighbours and the rank of
their buckets in the query's probing order, and the fewest probes that reach
the target recall are taken; where MOST_PROBES don't, buckets of fewer axes are,
in the end of one, all of which can be probed. Buckets above a bounded number of rows are
searched in pieces, so none is capped. See ``vectors`` for nulls and copies.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .vectors import Best, OfIds, distinct_vectors, expand, ranked, valid_vectors

TABLES = 4
#: Rows that a bucket should have on average; tables of more rows take two axes for a bucket.
BUCKET_ROWS = 16_384
PIECE_ROWS = 8_192
SHARD_ROWS = 32_768
#: Buckets are dealt to so many tasks at least; each hands on its best rows of a query.
LEAST_SHARDS = 12
SAMPLED_QUERIES = 96
TARGET_RECALL = 0.95
#: By so much, relatively, sums of another order may differ; nearly equal scores are summed again.
ROUNDING = 1e-12
#: Probing orders of several axes are followed so far, in so many numbers at a time.
MOST_PROBES = 4_096
ROOM = 1 << 22


def stored(dtype: str):
    """Components in the width that they came in; all sums are of doubles."""
    return lambda x: x.astype(dtype)


def doubles(raw: list[bytes], dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=dtype).reshape(len(raw), -1).astype(np.float64)


@cache
def signs(table: int, part: int, width: int) -> np.ndarray:
    return np.random.default_rng([20150531, table, part]).choice([-1.0, 1.0], size=(3, width))


def rotate(vectors: np.ndarray, table: int, part: int) -> np.ndarray:
    """Pseudo-rotated rows, padded to a power of two."""
    width = 1 << max(1, (vectors.shape[1] - 1).bit_length())
    x = np.zeros((len(vectors), width))
    x[:, : vectors.shape[1]] = vectors
    for flip in signs(table, part, width):
        x *= flip
        h = 1
        while h < width:
            x = x.reshape(len(x), -1, 2, h)
            x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), width)
            h *= 2
        x /= math.sqrt(width)
    return x


def axis_scores(vectors: np.ndarray, table: int, part: int) -> np.ndarray:
    """How near each signed axis is: positive axes, then negative ones."""
    x = rotate(vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), table, part)
    return np.concatenate([x, -x], axis=1)


def probing_order(vectors: np.ndarray, table: int, parts: int, most: int) -> np.ndarray:
    """Codes of the ``most`` buckets of a table that are nearest to each vector, the nearest first: a vector's own bucket.

    A tuple of axes among the nearest begins with one of the nearest shorter
    tuples, so tuples grow by a part at a time from those.
    """
    codes = sums = None
    for part in range(parts):
        scores = axis_scores(vectors, table, part)
        axes = np.argsort(-scores, axis=1, kind="stable")[:, :most]
        best = np.take_along_axis(scores, axes, axis=1)
        if codes is None:
            codes, sums = axes, best
            continue
        width, rows = scores.shape[1], max(1, ROOM // (codes.shape[1] * axes.shape[1]))
        grown = []
        for at in range(0, len(vectors), rows):
            own = slice(at, at + rows)
            both = (sums[own, :, None] + best[own, None, :]).reshape(len(sums[own]), -1)
            names = (codes[own, :, None] * width + axes[own, None, :]).reshape(both.shape)
            order = np.argsort(-both, axis=1, kind="stable")[:, :most]
            grown.append((np.take_along_axis(names, order, axis=1), np.take_along_axis(both, order, axis=1)))
        codes, sums = (np.concatenate(x) for x in zip(*grown))
    return codes


def own_buckets(vectors: np.ndarray, table: int, parts: int) -> np.ndarray:
    code = np.zeros(len(vectors), dtype=np.int64)
    for part in range(parts):
        scores = axis_scores(vectors, table, part)
        code = code * scores.shape[1] + scores.argmax(axis=1)
    return code


def calibrated_probes(distinct: DataFrame, sample: list, k: int, parts: int, target: float, dtype: str) -> int | None:
    """The fewest probed buckets a table that find ``target`` of the sampled queries' true neighbours; None if that takes too many."""
    by_dim: dict[int, list[bytes]] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(bytes(r["v"]))
    shared = distinct.sparkSession.sparkContext.broadcast(by_dim)

    def run(batches):
        prepared = {}
        for dim, raw in shared.value.items():
            asking = doubles(raw, dtype)
            codes = [probing_order(asking, t, parts, MOST_PROBES) for t in range(TABLES)]
            prepared[dim] = asking, [(np.argsort(c, axis=1), np.sort(c, axis=1)) for c in codes]
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            first_ids = batch.column("id").to_numpy(zero_copy_only=False)
            queries, names, scores, ranks = [], [], [], []
            for dim, (asking, orders) in prepared.items():
                rows = np.flatnonzero(dims == dim)
                if not len(rows):
                    continue
                vectors = doubles(batch.column("v").take(pa.array(rows)).to_pylist(), dtype)
                near, own_ids = asking @ vectors.T, first_ids[rows]
                repeated = len(np.unique(own_ids)) < len(own_ids)
                for q in range(len(asking)):
                    near[q, (vectors == asking[q]).all(axis=1)] = -np.inf
                    top = np.argsort(-near[q], kind="stable")
                    if repeated:  # an id counts with its best vector
                        top = top[np.sort(np.unique(own_ids[top], return_index=True)[1])]
                    top = top[:k]
                    top = top[np.isfinite(near[q, top])]
                    if not len(top):
                        continue
                    first = np.full(len(top), MOST_PROBES, dtype=np.int64)
                    for t, (order, sorted_codes) in enumerate(orders):
                        own = own_buckets(vectors[top], t, parts)
                        at = np.minimum(np.searchsorted(sorted_codes[q], own), sorted_codes.shape[1] - 1)
                        first = np.minimum(first, np.where(sorted_codes[q, at] == own, order[q, at], MOST_PROBES))
                    queries += [f"{dim}:{q}"] * len(top)
                    names.append(own_ids[top])
                    scores.append(near[q, top])
                    ranks.append(first)
            join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.string()), join(names, pa.int64()), join(scores, pa.float64()), join(ranks, pa.int64())], names=["q", "id", "score", "first"])

    seen = distinct.select("dim", "v", F.col("ids")[0].alias("id")).mapInArrow(run, "q string, id long, score double, first long")
    seen = seen.groupBy("q", "id").agg(F.max_by("first", "score").alias("first"), F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    needed = np.sort([r["first"] for r in seen.withColumn("nth", nth).filter(F.col("nth") <= k).select("first").collect()])  # SAMPLED_QUERIES * k rows
    if not len(needed):
        return 1
    probes = int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) + 1
    return probes if probes <= MOST_PROBES else None


def bucket_axes(rows: int, dim: int) -> int:
    """How many axes name a bucket, so that it has about BUCKET_ROWS rows or fewer."""
    width = 2 << max(1, (dim - 1).bit_length())
    parts = 1
    while width**parts * BUCKET_ROWS < rows:
        parts += 1
    return parts


def nearest(df: DataFrame, k: int, every: int, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score (double) of queries whose id is divisible by ``every``, among all other rows."""
    dtype = "<f4" if df.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    rows = cut(valid_vectors(df, id_col, vector_col, stored(dtype), zero=False))
    distinct = cut(distinct_vectors(rows, k))
    queries = rows.filter(F.col("id") % every == 0).withColumn("qkey", F.md5("v"))
    asked = cut(queries.groupBy("dim", "v", "qkey").agg(F.count("*").alias("n")).drop("n"))
    total, least_dim = distinct.agg(F.count("*"), F.coalesce(F.min("dim"), F.lit(1))).first()
    parts, sample = bucket_axes(total, least_dim), asked.orderBy("qkey").limit(SAMPLED_QUERIES).collect()
    while (probes := calibrated_probes(distinct, sample, k, parts, target, dtype)) is None:
        parts -= 1
    shards = max(LEAST_SHARDS, -(-total * TABLES // SHARD_ROWS))

    def buckets(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                vectors = doubles(own.column("v").to_pylist(), dtype)
                for t in range(TABLES):
                    code = pa.array(own_buckets(vectors, t, parts))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(code), t, np.int32)), code], names=[*own.schema.names, "t", "code"])

    def probed(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                for at in range(0, own.num_rows, 256):
                    some = own.slice(at, 256)
                    vectors = doubles(some.column("v").to_pylist(), dtype)
                    for t in range(TABLES):
                        codes = probing_order(vectors, t, parts, probes)
                        row = pa.array(np.repeat(np.arange(len(vectors)), codes.shape[1]))
                        yield pa.RecordBatch.from_arrays([*(c.take(row) for c in some.columns), pa.array(np.full(len(row), t, np.int32)), pa.array(codes.reshape(-1))], names=[*some.schema.names, "t", "code"])

    in_buckets = distinct.mapInArrow(buckets, "dim int, v binary, ids array<long>, t int, code long")
    probing = asked.mapInArrow(probed, "dim int, v binary, qkey string, t int, code long")
    by = ["dim", "t", "code"]
    pieces = in_buckets.groupBy(*by).agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces"))
    asking_pieces = probing.groupBy(*by).agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("asking"))
    sizes = cut(pieces.join(asking_pieces, by))  # one row a bucket
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shard = F.pmod(F.xxhash64("dim", "t", "code", "piece", "asking_piece"), F.lit(shards)).alias("shard")
    left = in_buckets.join(sizes, by).withColumn("piece", F.pmod(F.xxhash64("v"), F.col("pieces")).cast("int")).withColumn("asking_piece", each("asking"))
    right = probing.join(sizes, by).withColumn("asking_piece", F.pmod(F.xxhash64("v", F.lit(1)), F.col("asking")).cast("int")).withColumn("piece", each("pieces"))
    bucket = F.concat_ws(":", "dim", "t", "code", "piece", "asking_piece").alias("bucket")
    left = left.select(shard, bucket, "v", "ids")
    right = right.select(shard, bucket, "v", "qkey")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        best: dict[str, Best] = {}
        if left.num_rows and right.num_rows:
            asking_rows: dict[str, list[int]] = {}
            for i, b in enumerate(right.column("bucket").to_pylist()):
                asking_rows.setdefault(b, []).append(i)
            held: dict[str, list[int]] = {}
            for i, b in enumerate(left.column("bucket").to_pylist()):
                held.setdefault(b, []).append(i)
            vectors, lists = left.column("v").to_pylist(), left.column("ids").combine_chunks()
            offsets, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            asking, keys = right.column("v").to_pylist(), right.column("qkey").to_pylist()
            for b, members in held.items():
                if b not in asking_rows:
                    continue
                members = np.array(members)
                matrix = doubles([vectors[i] for i in members], dtype)
                of_ids = OfIds(values[offsets[members]])
                for at in range(0, len(asking_rows[b]), 512):
                    some = asking_rows[b][at : at + 512]
                    asked_vectors = dict(zip(some, doubles([asking[i] for i in some], dtype)))
                    scores = np.array(list(asked_vectors.values())) @ matrix.T
                    for own, i in zip(scores, some):
                        mine = best.setdefault(keys[i], Best(k + 1))
                        worst = mine.worst()
                        least = of_ids.nth(own, k)
                        if least is not None:
                            worst = least if worst is None else max(least, worst)
                        hits = np.flatnonzero(own >= worst - ROUNDING * (1 + abs(worst))) if worst is not None else np.arange(len(own))
                        if len(hits):
                            exact = (matrix[hits] * asked_vectors[i]).sum(axis=1)  # row by row: the same in every block
                            mine.add(*expand(members[hits], exact, offsets, values))
        keys_out = [key for key, b in best.items() for _ in range(len(b.ids))]
        join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table({"qkey": pa.array(keys_out, pa.string()), "id": join([b.ids for b in best.values()], pa.int64()), "score": join([b.scores for b in best.values()], pa.float64())})

    found = left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(meet, "qkey string, id long, score double")
    return ranked(found, queries, k, "double")
