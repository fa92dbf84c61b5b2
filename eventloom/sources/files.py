"""Listing files and reading byte ranges on executors."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import file_stem


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, file, stem, modified, length) of matching files; contents are not read."""
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    ).select("path", F.col("modificationTime").alias("modified"), "length")
    named = found.withColumn("file", F.element_at(F.split("path", "/"), -1))
    return named.withColumn("stem", file_stem(F.col("file")))


def read_range(path: str, start: int, size: int) -> bytes:
    """Part of a file on any file system Arrow knows; runs inside tasks."""
    from pyarrow import fs

    if re.match(r"^file:/", path) or path.startswith("/"):
        system, inner = fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    else:
        system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as handle:
        handle.seek(start)
        return handle.read(size)


def pending_files(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources without a target of the same stem, or with an older one.

    Both sides have ``stem`` and ``modified``.
    """
    newest = targets.groupBy("stem").agg(F.max("modified").alias("_done"))
    joined = sources.join(newest, "stem", "left")
    fresh = F.col("_done").isNull() | (F.col("_done") <= F.col("modified"))
    return joined.filter(fresh).drop("_done")
