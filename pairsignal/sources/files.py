"""Byte ranges of files from inside tasks, on any file system the executors can reach."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the files under ``path`` (may hold wildcards); contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def open_file(path: str):
    """A seekable file for a path as Spark lists it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[len("file:") :].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)
