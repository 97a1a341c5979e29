"""Files of the stores that Spark reads: first bytes by Spark's own file systems, streams inside tasks by pyarrow's."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from ..operators.errors import InputMissing, PermissionRefused

#: The bytes that formats begin with.
MAGIC = {
    b"\x1f\x8b": "gzip",
    b"\x28\xb5\x2f\xfd": "zstd",
    b"BZh": "bzip2",
    b"\xfd7zXZ\x00": "xz",
    b"\x04\x22\x4d\x18": "lz4",
    b"PAR1": "parquet",
}

#: Stores that a task can stream from.
STREAMED = re.compile(r"(file:|hdfs:|s3:|s3a:|gs:|/)")


def detect(head: bytes) -> str:
    """The format that a file's first bytes tell; its name says nothing."""
    return next((kind for magic, kind in MAGIC.items() if head.startswith(magic)), "plain")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modificationTime of every file of an input; no content is read."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise InputMissing(path) from e
        if "Permission denied" in str(e):
            raise PermissionRefused(path) from e
        raise


def first_bytes(spark: SparkSession, files: list[tuple[str, int]], n: int = 16) -> list[bytes]:
    """The first bytes of files, given with their lengths, from any store that Spark knows: a range read each."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def read(file: tuple[str, int]) -> bytes:
        path = jvm.org.apache.hadoop.fs.Path(file[0])
        stream = path.getFileSystem(conf).open(path)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, file[1])))
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(read, files))


def store(path: str):
    """A pyarrow file system and the name of ``path`` in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
    return fs.LocalFileSystem(), path


def unpacked(kind: str, file):
    """A binary stream of a compressed file's content."""
    import bz2
    import gzip
    import io
    import lzma

    import zstandard

    if kind == "plain":
        return io.BufferedReader(file, 1 << 20)
    if kind == "gzip":
        return gzip.GzipFile(fileobj=file)
    if kind == "bzip2":
        return bz2.BZ2File(file)
    if kind == "xz":
        return lzma.LZMAFile(file)
    return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True), 1 << 20)
