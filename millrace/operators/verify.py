"""Checks of a corpus: record lengths, JSON validity, coverage of ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import json_problem, json_valid
from .records import DEFAULT_MAX_LINE

KEPT_PROBLEMS = 8


def verify(df: DataFrame, max_line: int = DEFAULT_MAX_LINE, deep: bool = True) -> DataFrame:
    """One row: records, bytes, oversized, invalid_json and ok."""
    bad = ~json_valid("record") if deep else F.lit(False)
    total = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long").alias(name)
    counted = df.withColumn("__bad", bad).agg(F.count("*").alias("records"), total(F.col("nbytes"), "bytes"), total(F.col("nbytes") > max_line, "oversized"), total(F.col("__bad"), "invalid_json"))
    return counted.withColumn("ok", (F.col("oversized") == 0) & (F.col("invalid_json") == 0))


def problems(df: DataFrame, n: int = KEPT_PROBLEMS) -> DataFrame:
    """The first records that aren't JSON: id, pos, kind of problem and the byte at which it is."""
    found = df.withColumn("__p", json_problem("record")).filter("__p.kind IS NOT NULL").orderBy("pos").limit(n)
    return found.select("id", "pos", "__p.kind", "__p.at")


def ranks_cover(ids: DataFrame, ranks: list[DataFrame]) -> DataFrame:
    """One row: rows of ``ids``, how many of them some rank's output has, how many two have, and rows of ranks that aren't among them.

    ``ranks``: what each rank gets from a mode, with the column id.
    """
    tagged = ids.select("id", F.lit(-1).alias("rank"))
    for r, out in enumerate(ranks):
        tagged = tagged.unionByName(out.select("id", F.lit(r).alias("rank")))
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long").alias(name)
    wanted, taken, by = F.col("wanted"), F.col("taken"), F.col("ranks")
    of_id = tagged.groupBy("id").agg(F.count_if(F.col("rank") < 0).alias("wanted"), F.count_if(F.col("rank") >= 0).alias("taken"), (F.max("rank") - F.min(F.when(F.col("rank") >= 0, F.col("rank")))).alias("ranks"))
    return of_id.agg(count(wanted, "n_rows"), count(F.least(wanted, taken), "covered"), count(F.coalesce(by > 0, F.lit(False)), "overlap"), count(F.greatest(taken - wanted, F.lit(0)), "foreign"))


def rank_cover(df: DataFrame, world: int, position: str = "pos") -> DataFrame:
    """One row: rows, rows that some rank takes, and ids that two ranks take. One pass: each row is tried with every rank's rule."""
    taken = df.select("id", sum((F.pmod(F.col(position), F.lit(world)) == r).cast("int") for r in range(world)).alias("times"))
    of_id = taken.groupBy("id").agg(F.count("*").alias("n"), F.sum("times").alias("times"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return of_id.agg(total(F.col("n"), "n_rows"), total(F.col("times"), "covered"), total((F.col("times") > 1).cast("long"), "overlap"))
