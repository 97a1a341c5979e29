"""Parquet shards in name order, projections, and addresses of dataset repositories."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.errors import InputMissing, UsageError

ADDRESS = re.compile(r"hf://([^\s/@]+)/([^\s/@]+)(?:@(\S+))?")


def parse_address(url: str) -> tuple[str, str | None]:
    """("owner/name", revision or None) of an ``hf://owner/name[@revision]`` address."""
    found = ADDRESS.fullmatch(url)
    if not found:
        raise UsageError(f"not a dataset address: {url!r}")
    return f"{found[1]}/{found[2]}", found[3]


def local_copy(url: str, cache: str) -> str:
    """Where the shards of an address lie in a local cache (nothing is fetched)."""
    repo, revision = parse_address(url)
    path = os.path.join(cache, repo, revision or "main", "data")
    if not os.path.isdir(path):
        raise InputMissing(path)
    return path


def read_shards(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of one Parquet file or a folder of them, with file and row, whose order is the input's.

    A projection of unknown columns fails and names those there are.
    """
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    if columns is not None:
        if unknown := [c for c in columns if c not in df.columns]:
            raise UsageError(f"unknown columns {unknown}; there are {df.columns}")
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    return df.select(*place, *(columns or df.columns))
