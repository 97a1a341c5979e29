"""The same operators on streams: reservoir, buffer, epochs.

Filters (ranks by id, Bernoulli, entropy, length policy) and run statistics work
on a streaming DataFrame as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.prf import prf_mod
from ..operators.shuffle import index_perm


def reservoir(stream: DataFrame, size: int, seed: int = 0, position: str = "pos") -> DataFrame:
    """slot and the row that holds it so far, for output mode ``complete``: a sample of all rows up to now.

    State is one row a slot, so it is bounded by ``size`` however long the stream.
    """
    slot = F.when(F.col(position) < size, F.col(position)).otherwise(prf_mod(seed, "res", 0, F.col(position) + 1, position))
    return stream.withColumn("slot", slot).filter(F.col("slot") < size).groupBy("slot").agg(F.max_by(F.struct(*stream.columns), position).alias("row"))


def buffer(stream: DataFrame, size: int, seed: int = 0, position: str = "pos", drain_after: str | None = None) -> DataFrame:
    """Records in the order in which they leave a ring of ``size`` slots: pos, record and out_pos.

    State is the record of each slot. With ``drain_after`` (milliseconds) slots
    that get no record for so long give up theirs, with a null out_pos.
    """
    slot = F.when(F.col(position) < size, F.col(position)).otherwise(prf_mod(seed, "buf", 0, size, position))
    wait = int(drain_after) if drain_after else None

    def work(key, frames, state: GroupState):
        held = state.getOption
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"pos": [held[0]], "record": [held[1]], "out_pos": pd.array([None], dtype="Int64")})
            return
        rows = pd.concat(list(frames)).sort_values(position)
        out = []
        for pos, record in zip(rows[position], rows["record"]):
            if held is not None:
                out.append((held[0], held[1], int(pos) - size))
            held = (int(pos), record)
        state.update(held)
        if wait:
            state.setTimeoutDuration(wait)
        if out:
            yield pd.DataFrame(out, columns=["pos", "record", "out_pos"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    return stream.withColumn("slot", slot).groupBy("slot").applyInPandasWithState(work, "pos long, record string, out_pos long", "pos long, record string", "append", timeout)


def endless_epochs(spark: SparkSession, df: DataFrame, take: Callable[[DataFrame, int], None], seed: int = 0, every: str = "1 second", id_col: str = "id"):
    """A streaming query that hands ``take`` one permutation of ``df`` an epoch, until it is stopped.

    The next epoch is kept by the query's checkpoint, so a restart goes on where it was.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def epoch(_, number: int) -> None:
        take(index_perm(df, seed, number, id_col), number)

    return ticks.writeStream.foreachBatch(epoch).trigger(processingTime=every)
