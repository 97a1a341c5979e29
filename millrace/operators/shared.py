"""Cutting lineage in the folder that the whole cluster shares; running sums in two levels."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .errors import UsageError


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local session may go without: it gets a folder of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not where:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise UsageError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            where = tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(where)
    return context.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def running_before(df: DataFrame, position: str, value: str, groups: tuple[str, ...] = (), name: str = "before", run_bits: int = 16) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of a group at smaller positions.

    Two levels: within runs of 2^run_bits positions, and over the runs' totals,
    so that no task sees more than a run, or one row a run.
    """
    rows = df.withColumn("__run", F.shiftright(F.col(position).cast("long"), run_bits))
    totals = rows.groupBy(*groups, "__run").agg(F.sum(value).alias("__total"))
    over_runs = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__run").rowsBetween(Window.unboundedPreceding, 0)
    firsts = totals.withColumn("__run_first", F.sum("__total").over(over_runs) - F.col("__total")).drop("__total")
    within = Window.partitionBy(*groups, "__run").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("__within", F.sum(value).over(within) - F.col(value))
    return summed.join(firsts, [*groups, "__run"]).withColumn(name, (F.col("__run_first") + F.col("__within")).cast("long")).drop("__run", "__run_first", "__within")
