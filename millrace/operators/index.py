"""A saved record index that is used again while its input is unchanged, and a catalogue of inputs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InputMissing, UsageError

DATASET_ID = re.compile(r"[A-Za-z0-9._-]+")


def fingerprint(spark: SparkSession, path: str | list[str]) -> str:
    """A hash of names, sizes and times of an input's files; only metadata is read. Of several inputs, one of theirs in turn."""
    if not isinstance(path, str):
        return hashlib.sha256("|".join(fingerprint(spark, p) for p in path).encode()).hexdigest()
    try:
        files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length", F.unix_micros("modificationTime").alias("at"))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise InputMissing(path) from e
        raise
    rows = files.select(F.sha2(F.concat_ws("|", "name", "length", "at"), 256).alias("h"))
    return rows.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("h"))), 256)).first()[0]  # one hash a file


def cached_index(spark: SparkSession, path: str | list[str], where: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The index saved under ``where`` for this state of the input, else a newly built one, saved for next time."""
    return looked_up_index(spark, path, where, build)[0]


def looked_up_index(spark: SparkSession, path: str | list[str], where: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """``cached_index``, and whether it was found rather than built."""
    saved = f"{where}/{fingerprint(spark, path)}"
    try:
        return spark.read.parquet(saved), True
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    build().write.mode("overwrite").parquet(saved)
    return spark.read.parquet(saved), False


class Catalogue:
    """Named inputs, fixed when it is made."""

    def __init__(self, spark: SparkSession, paths: list[tuple[str, str]]):
        self.spark = spark
        self.entries: dict[str, tuple[str, str]] = {}
        for name, path in paths:
            if not DATASET_ID.fullmatch(name):
                raise UsageError(f"bad dataset id {name!r}")
            if name in self.entries:
                raise UsageError(f"dataset id {name!r} is given twice")
            self.entries[name] = (path, fingerprint(spark, path))

    def path(self, name: str) -> str:
        if name not in self.entries:
            raise InputMissing(name)
        return self.entries[name][0]

    def as_table(self) -> DataFrame:
        return self.spark.createDataFrame([(n, p, f) for n, (p, f) in self.entries.items()], "id string, path string, fingerprint string")
