"""Files read by byte range inside tasks, through pyarrow's file systems (local, HDFS, S3 and others by URI)."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def open_ranges(path: str):
    """A seekable file of a path as Spark names it; nothing is read yet."""
    uri = re.sub(r"\A(file):/(?!/)", r"\1:///", path)
    system, inner = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return system.open_input_file(inner)


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length, modificationTime) of the files below ``path`` whose names fit a glob; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime")
