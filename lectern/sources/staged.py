"""Staged publishing: a run's files stand aside until one pointer is switched, so readers see all of a run or none.

    root/runs/<run>/<key>_key=.../part-*.parquet    what a run wrote
    root/snapshots/<run>                            a row a file: partition, path, bytes, SHA-256
    root/CURRENT                                    the name of the run that readers use

A snapshot lists the files of every partition, those of earlier runs among them, so a run writes only partitions that
it changes. Digests are computed in tasks from the files as they lie, not from the rows that were meant to be written.
CURRENT is written beside itself and renamed over, which is atomic where the store's rename is (HDFS, local disks). Stores
without such a rename need a commit service of their own.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.broadcasts import row_bytes, small_or_shuffled
from lectern.plans.scratch import stored

SNAPSHOT = "partition string, path string, bytes long, sha256 string"
BROADCAST_ROWS = 100_000
#: Rows and bytes of values that one file should have: a task sorts what it writes and digests a file whole.
FILE_ROWS = 250_000
FILE_BYTES = 128 << 20


class DamagedTable(ValueError):
    """A published file is missing or not what was published."""


@dataclass
class Staged:
    """A run that is complete on disk and not yet visible."""

    root: str
    run: str
    partitions: list[str]


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_run(spark: SparkSession, root: str) -> str | None:
    _, path, system = _hadoop(spark, f"{root}/CURRENT")
    if not system.exists(path):
        return None
    return spark.read.text(f"{root}/CURRENT").first()[0]


def snapshot(spark: SparkSession, root: str, run: str | None = None) -> DataFrame | None:
    """(partition, path, bytes, sha256) of the files of a run, the current one by default."""
    run = run or current_run(spark, root)
    return None if run is None else spark.read.schema(SNAPSHOT).parquet(f"{root}/snapshots/{run}")


def read(spark: SparkSession, root: str, schema=None) -> DataFrame | None:
    """The current rows; None before the first run. A reader keeps the files that it started with, whatever is published meanwhile."""
    files = snapshot(spark, root)
    if files is None:
        return None
    paths = [r["path"] for r in files.select("path").orderBy("path").collect()]
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths) if paths else None


def _digests(spark: SparkSession, folder: str) -> DataFrame:
    """(partition, path, bytes, sha256) of the Parquet files below a folder, each digested by a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"/([^/]*)/[^/]*\z", 1).alias("partition"), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _dealt(rows: DataFrame, key: str, least: int) -> DataFrame:
    """A stored table in partitions of about ``FILE_ROWS`` rows or ``FILE_BYTES``; a value's rows lie in as few as hold them."""
    pieces = F.ceil(F.greatest(F.count(F.lit(1)) / FILE_ROWS, F.sum(row_bytes(rows)) / FILE_BYTES, F.lit(least)))
    sizes = stored(rows.groupBy(F.col(key).alias("_of")).agg(F.count(F.lit(1)).alias("_n"), F.sum(row_bytes(rows)).alias("_bytes"), pieces.alias("_pieces")), "staged-sizes")
    n, size = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    slots = max(rows.sparkSession.sparkContext.defaultParallelism, least, 2 * math.ceil(max(n / FILE_ROWS, size / FILE_BYTES)))
    placed = rows.withColumn("_place", F.monotonically_increasing_id()).join(small_or_shuffled(sizes, BROADCAST_ROWS), F.col(key).eqNullSafe(F.col("_of")))
    slot = F.pmod(F.xxhash64(key) + F.pmod("_place", "_pieces"), F.lit(slots)).cast("int")
    return placed.repartitionById(slots, slot).select(*rows.columns)


def stage(rows: DataFrame, root: str, key: str, run: str | None = None, files_a_partition: int = 1) -> Staged:
    """Write ``rows`` aside, a folder for each value of ``key``, with digests and the next snapshot; readers see nothing of it.

    A run replaces the partitions that its rows have and keeps all others. The rows are stored and counted first, so that a value
    gets as many files, and the write as many tasks, as its rows and bytes need; ``files_a_partition`` is the least number of files.
    """
    spark = rows.sparkSession
    run = run or uuid.uuid4().hex
    folder = f"{root}/runs/{run}"
    dealt = _dealt(stored(rows.withColumn(f"{key}_key", F.col(key)), "staged-rows"), f"{key}_key", files_a_partition)
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy(f"{key}_key").parquet(folder)
    _, path, system = _hadoop(spark, folder)
    wrote = any(s.isDirectory() for s in system.listStatus(path))
    fresh = stored(_digests(spark, folder), "staged-files") if wrote else spark.createDataFrame([], SNAPSHOT)
    old = snapshot(spark, root)
    changed = fresh.select("partition").distinct()
    whole = fresh if old is None else fresh.unionByName(old.join(small_or_shuffled(changed, BROADCAST_ROWS), "partition", "left_anti"))
    whole.coalesce(1).write.mode("overwrite").parquet(f"{root}/snapshots/{run}")
    return Staged(root, run, sorted(r[0] for r in changed.collect()))


def switch(spark: SparkSession, staged: Staged) -> None:
    """Make a staged run the current one: the pointer is written aside and renamed over the last one."""
    jvm, aside, system = _hadoop(spark, f"{staged.root}/.CURRENT-{staged.run}")
    out = system.create(aside, True)
    out.write(bytearray(staged.run, "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(aside), context.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{staged.root}/CURRENT")), over)


def publish(rows: DataFrame, root: str, key: str, run: str | None = None) -> Staged:
    """Stage and switch."""
    staged = stage(rows, root, key, run)
    switch(rows.sparkSession, staged)
    return staged


def verify(spark: SparkSession, root: str) -> int:
    """Digest every current file anew, in tasks; returns how many there are, or names one that is not what was published."""
    files = snapshot(spark, root)
    if files is None:
        return 0
    folders = sorted({r[0] for r in files.select(F.regexp_extract("path", r"(?s)(.*)/[^/]*/[^/]*\z", 1)).distinct().collect()})  # one a run
    now = None
    for folder in folders:
        _, path, system = _hadoop(spark, folder)
        if system.exists(path):
            found = _digests(spark, folder)
            now = found if now is None else now.unionByName(found)
    seen = (spark.createDataFrame([], SNAPSHOT) if now is None else now).select("path", F.col("sha256").alias("now"))
    bad = files.join(seen, "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("now"))).orderBy("path").first()
    if bad is not None:
        raise DamagedTable(f"{bad['path']} is {'missing' if bad['now'] is None else 'not what was published'}")
    return files.count()


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Delete runs that no file of the current snapshot belongs to, such as those of killed jobs; returns their names.

    Call it when no reader is older than the current snapshot.
    """
    files = snapshot(spark, root)
    used = set() if files is None else {r[0] for r in files.select(F.regexp_extract("path", r"/runs/([^/]*)/", 1)).distinct().collect()}
    used |= {current_run(spark, root)}
    _, path, system = _hadoop(spark, f"{root}/runs")
    gone = [s.getPath() for s in system.listStatus(path) if s.getPath().getName() not in used] if system.exists(path) else []
    for run in gone:
        system.delete(run, True)
    return sorted(run.getName() for run in gone)
