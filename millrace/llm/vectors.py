"""What both vector searches share: valid vectors, copies as one, and ranks per query.

Rows whose id is null, and vectors that are null, empty or hold null or
non-finite components, take no part; only vectors of one dimension are compared.
Equal vectors are searched once, with the smallest of their ids: no more than
k + 1 of them can be among a query's k nearest, as ties go to smaller ids.
Rows that repeat both id and vector count once. Where an id has several vectors,
each is searched, and as a candidate and as a query the id counts with its best
score: what is kept of a query's rows is one row an id, with room for k others
and the query's own. An empty table gives no
rows. Columns of other names are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, encode: Callable[[np.ndarray], np.ndarray], zero: bool) -> DataFrame:
    """id, dim, v (bytes of ``encode`` of the components as doubles). ``zero``: whether all-zero vectors take part."""

    def run(batches):
        for batch in batches:
            lists = batch.column("vector")
            keep, raw = [], []
            values, offsets = lists.values, lists.offsets.to_numpy()
            numbers = pc.cast(values, pa.float64()).to_numpy(zero_copy_only=False)
            fine = np.isfinite(numbers)  # nulls became NaN
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            for k in range(len(lists)):
                a, b = offsets[k], offsets[k + 1]
                if there[k] and b > a and fine[a:b].all() and (zero or numbers[a:b].any()):
                    keep.append(k)
                    raw.append(encode(numbers[a:b] + 0.0).tobytes())
            dims = (offsets[1:] - offsets[:-1])[keep]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep, pa.int64())), pa.array(dims.astype(np.int32)), pa.array(raw, pa.binary())], names=["id", "dim", "v"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter("id is not null")
    return rows.mapInArrow(run, "id long, dim int, v binary")


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """dim, v, ids: the k + 1 smallest ids of each vector, ascending. The limit is also applied before the shuffle."""
    order = F.row_number().over(Window.partitionBy("dim", "v").orderBy("id"))
    least = rows.select("dim", "v", "id").distinct().withColumn("nth", order).filter(F.col("nth") <= k + 1)
    return least.groupBy("dim", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def unpack(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    """A matrix from byte strings of one length."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=dtype).reshape(len(raw), -1) if raw else np.zeros((0, 0), dtype=dtype)


class Best:
    """The best ids of a query so far, each with its best score: score descending, id ascending."""

    def __init__(self, room: int):
        self.room = room
        self.scores: np.ndarray | None = None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.scores is not None:
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))
        firsts = np.sort(np.unique(ids[order], return_index=True)[1])
        order = order[firsts[: self.room]]
        self.scores, self.ids = scores[order], ids[order]

    def worst(self):
        """The last score once the room is full."""
        return self.scores[-1] if self.scores is not None and len(self.scores) >= self.room else None


class OfIds:
    """Rows by their id, for the best score of each of many ids."""

    def __init__(self, ids: np.ndarray):
        names, self.group = np.unique(ids, return_inverse=True)
        self.n, self.repeated = len(names), len(names) < len(ids)

    def nth(self, scores: np.ndarray, n: int) -> float | None:
        """The n-th best score of different ids, from 0; None if there are fewer."""
        if self.n <= n:
            return None
        if self.repeated:
            best = np.full(self.n, np.iinfo(scores.dtype).min if scores.dtype.kind == "i" else -np.inf, dtype=scores.dtype)
            np.maximum.at(best, self.group, scores)
            scores = best
        return np.partition(scores, len(scores) - n - 1)[len(scores) - n - 1]


def expand(hits: np.ndarray, scores: np.ndarray, id_offsets: np.ndarray, id_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the rows behind distinct vectors ``hits``."""
    counts = id_offsets[hits + 1] - id_offsets[hits]
    at = np.repeat(id_offsets[hits] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return np.repeat(scores, counts), id_values[at]


def ranked(found: DataFrame, queries: DataFrame, k: int, score: str) -> DataFrame:
    """query_id, rank, vec_id, score. ``found``: qkey, id, score; ``queries``: every query row, id and qkey."""
    best = found.groupBy("qkey", "id").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "id"))
    best = best.withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth")
    own = queries.select(F.col("id").alias("query_id"), "qkey").distinct().join(best, "qkey").filter(F.col("query_id") != F.col("id"))
    own = own.groupBy("query_id", "id").agg(F.max("score").alias("score"))  # an id may ask with several vectors
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast(score).alias("score"))
