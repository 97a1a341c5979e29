"""Is a corpus safe to shuffle frame by frame? Byte drift between frames, and record lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prf import prf_hex
from .errors import UnsafeOrder

#: Limits of the verdict.
MAX_KL, MAX_JS, MAX_CV = 0.10, 0.10, 0.50
LN2 = float(np.log(2.0))
SAMPLE_FRAMES = 32


def sample_frames(df: DataFrame, frames: int = SAMPLE_FRAMES) -> DataFrame:
    """Rows of at most so many frames, the same ones in every run."""
    chosen = df.select("frame_id").distinct().orderBy(prf_hex(0, "analyze", 0, "frame_id"), "frame_id").limit(frames)
    return df.join(F.broadcast(chosen), "frame_id", "left_semi")


def byte_histogram(df: DataFrame, record: str = "record") -> DataFrame:
    """frame_id, byte, n. Bytes are counted batch by batch before they are grouped; records include their line end."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            frames, inverse = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            counts = np.zeros((len(frames), 256), dtype=np.int64)
            for k, text in zip(inverse.tolist(), batch.column(1).to_pylist()):
                counts[k] += np.bincount(np.frombuffer((text or b"") + b"\n", dtype=np.uint8), minlength=256)
            row, byte = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(frames[row]), pa.array(byte.astype(np.int32)), pa.array(counts[row, byte])], names=["frame_id", "byte", "n"])

    kind = df.schema["frame_id"].dataType.simpleString()
    partial = df.select("frame_id", F.col(record).cast("binary")).mapInArrow(run, f"frame_id {kind}, byte int, n long")
    return partial.groupBy("frame_id", "byte").agg(F.sum("n").alias("n"))


def divergence(histogram: DataFrame) -> DataFrame:
    """Per frame: kl and js to all sampled bytes, and its entropy, in nats."""
    p_all = histogram.groupBy("byte").agg(F.sum("n").alias("nq"))  # at most 256 rows
    sizes = histogram.groupBy("frame_id").agg(F.sum("n").alias("np"))
    total = p_all.groupBy().agg(F.sum("nq")).first()[0] or 1
    rows = histogram.join(F.broadcast(p_all), "byte").join(sizes, "frame_id").withColumn("p", F.col("n") / F.col("np")).withColumn("q", F.col("nq") / F.lit(total))
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    # where a frame lacks a byte, m is q / 2: those add half of ln 2 times their share of q
    js = 0.5 * F.sum(p * F.ln(p / m)) + 0.5 * F.sum(q * F.ln(q / m)) + 0.5 * LN2 * (1 - F.sum(q))
    return rows.groupBy("frame_id").agg(F.sum(p * F.ln(p / q)).alias("kl"), js.alias("js"), (-F.sum(p * F.ln(p))).alias("entropy"))


def length_cv(df: DataFrame) -> DataFrame:
    """One row: population deviation of frames' mean record lengths over their mean; 0 for fewer than two frames."""
    means = df.groupBy("frame_id").agg(F.avg("nbytes").alias("m"))
    return means.agg(F.when((F.count("*") < 2) | (F.avg("m") == 0), 0.0).otherwise(F.stddev_pop("m") / F.avg("m")).alias("length_cv"))


def unsafe(kl_max: Column, js_max: Column, cv: Column) -> Column:
    return (kl_max > MAX_KL) | (js_max > MAX_JS) | (cv > MAX_CV)


def qualify(value: Column, limit: float) -> Column:
    return F.when(value < 0.5 * limit, "uniform").when(value < limit, "mild drift").otherwise("SKEWED")


#: Points at which record lengths are compared.
LENGTH_POINTS = (0.1, 0.5, 0.9)
FIRST_WORD = r"^\s*(\S+)"


def length_drift(df: DataFrame, accuracy: int | None = 10_000) -> DataFrame:
    """frame_id and length_drift: how far the frame's record lengths at LENGTH_POINTS lie from those of all, as a share of these.

    Lengths are summed up in quantile sketches, whose ranks are wrong by 1 / accuracy at most; exactly with ``accuracy`` None.
    """
    points = F.array(*map(F.lit, LENGTH_POINTS))
    sketch = (F.percentile("nbytes", points) if accuracy is None else F.percentile_approx("nbytes", points, accuracy)).cast("array<double>")
    one = F.lit(1).alias("__one")
    every = df.agg(sketch.alias("q")).select("q", one)
    apart = F.array_max(F.zip_with("p", "q", lambda p, q: F.abs(p / q - 1)))
    return df.groupBy("frame_id").agg(sketch.alias("p")).select("frame_id", "p", one).join(F.broadcast(every), "__one").select("frame_id", apart.alias("length_drift"))  # one row


def prefix_drift(df: DataFrame, record: str = "record") -> DataFrame:
    """frame_id and prefix_kl, in nats: from the first words of the frame's records to those of all; records without a word have the empty one."""
    word = F.regexp_extract(F.col(record).cast("string"), FIRST_WORD, 1)
    counts = df.select("frame_id", word.alias("word")).groupBy("frame_id", "word").agg(F.count("*").alias("n"))
    every = counts.groupBy("word").agg(F.sum("n").alias("all"))
    total = counts.agg(F.sum("n").alias("total")).withColumn("__one", F.lit(1))
    of_frame = counts.groupBy("frame_id").agg(F.sum("n").alias("of_frame"))
    p, q = F.col("n") / F.col("of_frame"), F.col("all") / F.col("total")
    joined = counts.join(every, "word").join(of_frame, "frame_id").withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one")  # one row
    return joined.groupBy("frame_id").agg(F.sum(p * F.log(p / q)).alias("prefix_kl"))


def drift(df: DataFrame, frames: int = SAMPLE_FRAMES, records: DataFrame | None = None, accuracy: int | None = 10_000) -> DataFrame:
    """One row over sampled frames: length_drift_max, length_drift_mean, prefix_kl_max and prefix_kl_mean. ``records`` as in ``report``."""
    some = sample_frames(df, frames)
    if records is not None:
        some = some.join(records.select("id", "record"), "id")
    both = length_drift(some, accuracy).join(prefix_drift(some), "frame_id")
    return both.agg(*(F.coalesce(f(c), F.lit(0.0)).alias(f"{c}_{n}") for c in ("length_drift", "prefix_kl") for f, n in ((F.max, "max"), (F.avg, "mean"))))


def report(df: DataFrame, frames: int = SAMPLE_FRAMES, strict: bool = False, records: DataFrame | None = None) -> DataFrame:
    """One row with the maxima, means, labels and the verdict. ``strict`` raises on an unsafe one.

    With ``records`` (id and record), ``df`` needs no records itself: those of the sampled frames are looked up by id.
    """
    some = sample_frames(df, frames)
    if records is not None:
        some = some.join(records.select("id", "record"), "id")
    drift = divergence(byte_histogram(some)).agg(
        F.count("*").alias("frames"),
        *(F.coalesce(f(c), F.lit(0.0)).alias(n) for f, c, n in ((F.max, "kl", "kl_max"), (F.avg, "kl", "kl_mean"), (F.max, "js", "js_max"), (F.avg, "js", "js_mean"), (F.avg, "entropy", "entropy_mean"))),
    )
    both = drift.withColumn("one", F.lit(1)).join(length_cv(some).withColumn("one", F.lit(1)), "one").drop("one")  # one row each
    kl, js, cv = F.col("kl_max"), F.col("js_max"), F.col("length_cv")
    out = both.withColumns({"kl_label": qualify(kl, MAX_KL), "js_label": qualify(js, MAX_JS), "cv_label": qualify(cv, MAX_CV), "verdict": F.when(unsafe(kl, js, cv), "UNSAFE").otherwise("SAFE")})
    if strict and out.first()["verdict"] == "UNSAFE":
        raise UnsafeOrder("frames differ too much for frame-local shuffling")
    return out
