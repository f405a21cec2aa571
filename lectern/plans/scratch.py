"""Tables written to the folder that every executor shares, to cut lineage or reuse a result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root = ""


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only where none is set (tests)."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _local_root = _local_root or "file://" + tempfile.mkdtemp(prefix="lectern-")
        root = _local_root
    return root.rstrip("/")


def application_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/lectern/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The files outlive executors, so a lost executor costs a task retry and never a recomputation of
    what came before. They are scratch: :func:`clear` deletes an application's.
    """
    path = f"{application_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the store has ``path``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def clear(spark: SparkSession) -> bool:
    """Delete all tables that this application stored; results that were made from them must have been written by then."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(application_root(spark))
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
