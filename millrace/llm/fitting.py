"""Small logistic fits on bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_struct, crc32_remainder, in_slices


def labelled_sample(labels: DataFrame, label: str, modulus: int, held_out: int, rows: int, id_col: str = "doc_id") -> DataFrame:
    """id and y of at most ``rows`` labelled rows outside the held-out fold, by the hash of their id.

    Rows without an id or label give nothing; ids that have several labels take the largest.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).filter(crc32_remainder(id_col, modulus) != held_out)
    one = usable.groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    return one.orderBy(F.xxhash64(id_col), id_col).limit(rows)


def labelled_texts(documents: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, y and text of the sampled documents, and ``order``, by which one of several rows with an id is taken."""
    texts = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(f"`{text_col}`").alias("order"))
    return texts.join(F.broadcast(sample.withColumnRenamed(id_col, "id")), "id")  # a bounded sample


def one_an_id(features: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, one row an id (combined before the shuffle), in the order of ids."""
    found = features.groupBy("id").agg(F.min_by(F.struct("features", "y"), "order").alias("r")).orderBy("id").select("r.*").collect()
    return np.array([r["features"] for r in found]), np.array([r["y"] for r in found], dtype=int)


def scored(documents: DataFrame, score: Callable, at: float, id_col: str, text_col: str, keep: list[str] | None, fold: tuple[int, int], names: tuple[str, str, str]) -> DataFrame:
    """``keep`` columns (else id_col) of every row, and, named by ``names``, held_out, score and predicted (1: score >= ``at``).

    ``score`` gives a task's function from a list of texts to their scores.
    """
    keep = keep or [id_col]

    def run(batches):
        of_texts = score()
        for batch in in_slices(batches):
            s = of_texts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("kept"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= at).astype(np.int32))], names=["kept", "held_out", "score", "predicted"])

    rows = documents.select(as_struct(keep).alias("kept"), (crc32_remainder(id_col, fold[0]) == fold[1]).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    kinds = [("kept", rows.schema["kept"].dataType), ("held_out", T.BooleanType()), ("score", T.DoubleType()), ("predicted", T.IntegerType())]
    return rows.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in kinds])).select("kept.*", *(F.col(c).alias(n) for c, n in zip(("held_out", "score", "predicted"), names)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Coefficients of y in {0, 1} on the columns of x by Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) / len(x) + ridge * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w
