"""Records with positions, the long-record policy, ranks, sampling and run statistics.

A record view has columns id, pos (0-based), nbytes (with the line end) and
whatever else the caller keeps. Nulls in a record count as empty ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prf import prf_unit
from ..functions.records import byte_entropy
from .errors import UsageError
from .shared import cut, running_before

DEFAULT_MAX_LINE = 16 << 20
LN2 = 0.6931471805599453


def with_position(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """``df`` with 0-based positions in ascending ``order``, without gathering the rows in one task.

    The rows are dealt by range and sorted; one count a partition gives each
    partition's first position. They stay dealt and sorted so.
    """
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__row", F.monotonically_increasing_id())
    dealt = dealt.withColumn("__part", F.shiftright("__row", 33))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a partition
    firsts = running_before(counts, "__part", "__n", name="__first").drop("__n")
    place = F.col("__first") + F.col("__row").bitwiseAND((1 << 33) - 1)
    return dealt.join(F.broadcast(firsts), "__part").withColumn(name, place.cast("long")).drop("__row", "__part", "__first")


def record_view(df: DataFrame, id_col: str, record: Column | str, *keep: str) -> DataFrame:
    """id, record, nbytes and ``keep``."""
    record = F.col(record) if isinstance(record, str) else record
    text = F.coalesce(record.cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), text.alias("record"), (F.octet_length(text) + 1).cast("long").alias("nbytes"), *keep)


def concat(*frames: DataFrame) -> DataFrame:
    """Inputs in order, told apart by file_id."""
    return reduce(DataFrame.unionByName, [f.withColumn("file_id", F.lit(i)) for i, f in enumerate(frames)])


def limit_length(df: DataFrame, max_line: int = DEFAULT_MAX_LINE, on_error: str = "skip") -> DataFrame:
    """Records of more than ``max_line`` bytes are dropped, kept (passthrough) or make the query fail."""
    too_long = F.col("nbytes") > max_line
    if on_error == "skip":
        return df.filter(~too_long)
    if on_error == "passthrough":
        return df
    if on_error == "fail":  # a plan can only fail as a whole: see too_long for an error to catch
        message = F.concat(F.lit("record of "), F.col("nbytes").cast("string"), F.lit(f" bytes exceeds {max_line}"))
        return df.filter(F.when(too_long, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    raise UsageError(f"unknown policy {on_error!r}")


def too_long(df: DataFrame, max_line: int = DEFAULT_MAX_LINE) -> int:
    """How many records are longer than ``max_line``."""
    return df.filter(F.col("nbytes") > max_line).count()


def of_rank(df: DataFrame, rank: int | None, world: int | None, position: str = "pos") -> DataFrame:
    """Every ``world``-th row from ``rank`` on; all rows unless both are set and make sense."""
    if rank is None or world is None or world <= 1 or not 0 <= rank < world:
        return df
    return df.filter(F.pmod(F.col(position), F.lit(world)) == rank)


def bernoulli(df: DataFrame, rate: float, seed: int = 0, id_col: str = "id") -> DataFrame:
    if not 0 <= rate <= 1:
        raise UsageError("a rate lies between 0 and 1")
    return df.filter(prf_unit(seed, "bern", 0, id_col) < rate)


def entropy_gate(df: DataFrame, min_bits: float | None = None, max_bits: float | None = None, record: str = "record") -> DataFrame:
    """Rows whose byte entropy lies within bounds given in bits; the column entropy is in nats."""
    out = df.withColumn("entropy", byte_entropy(record))
    if min_bits is not None:
        out = out.filter(F.col("entropy") >= min_bits * LN2)
    if max_bits is not None:
        out = out.filter(F.col("entropy") <= max_bits * LN2)
    return out


def gate_counts(df: DataFrame, min_bits: float, max_bits: float, record: str = "record") -> DataFrame:
    """kept, dropped_low and dropped_high of the entropy gate; low is tested first."""
    h = F.col("entropy")
    low, high = h < min_bits * LN2, h > max_bits * LN2
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long").alias(name)
    return df.withColumn("entropy", byte_entropy(record)).agg(count(~low & ~high, "kept"), count(low, "dropped_low"), count(~low & high, "dropped_high"))


def head(df: DataFrame, n: int, order: str = "pos") -> DataFrame:
    return df.orderBy(order).limit(n)


def sampling_pipeline(df: DataFrame, rate: float, seed: int, min_bits: float | None, max_bits: float | None, limit: int | None) -> DataFrame:
    """Bernoulli, then entropy, then the first rows that are left: the cheap test first."""
    out = entropy_gate(bernoulli(df, rate, seed), min_bits, max_bits)
    return out if limit is None else head(out, limit)


def weighted_mix(frames: dict[str, DataFrame], weights: dict[str, float], seed: int = 0, id_col: str = "id") -> DataFrame:
    """A union that keeps each input's rows with its weight as probability."""
    parts = [f.filter(prf_unit(seed, f"mix:{name}", 0, id_col) < weights[name]).withColumn("input", F.lit(name)) for name, f in sorted(frames.items())]
    return reduce(DataFrame.unionByName, parts)


def run_stats(df: DataFrame, max_line: int, on_error: str = "skip", trailing_partial: int | None = None) -> DataFrame:
    """One row: records and bytes in and out, and long records skipped and passed.

    ``trailing_partial``: how many inputs end without a line feed, if known. Their
    missing line ends don't count as bytes in, and had_trailing_partial is added;
    every record that goes out has its line end.
    """
    long_one = F.col("nbytes") > max_line
    out = ~long_one if on_error == "skip" else F.lit(True)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    stats = df.agg(
        F.count("*").cast("long").alias("records_in"),
        total(out.cast("long"), "records_out"),
        total(F.col("nbytes"), "bytes_in"),
        total(F.when(out, F.col("nbytes")).otherwise(0), "bytes_out"),
        total((long_one & F.lit(on_error == "skip")).cast("long"), "oversized_skipped"),
        total((long_one & F.lit(on_error == "passthrough")).cast("long"), "oversized_passthrough"),
    )
    if trailing_partial is None:
        return stats
    return stats.withColumn("bytes_in", F.col("bytes_in") - trailing_partial).withColumn("had_trailing_partial", F.lit(trailing_partial > 0))
