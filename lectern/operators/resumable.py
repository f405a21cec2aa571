"""Shard sums that survive a stop: committed wave by wave, and a restarted run scores only what is left.

Shards are dealt to waves that are large enough to keep a cluster busy. A wave's sums are written to a folder of their own,
and then its shards are logged as done, with the keys of their files and settings; a wave without log rows never counts.
So a run stopped after k shards scores the rest, and changed files or settings make their own shards stale and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.scoring import Scorer
from lectern.operators.incremental import shard_sums
from lectern.plans.scratch import exists, stored

DONE = "shard string, files_key string, settings string, wave string"
KEYS = ["shard", "files_key", "settings"]
#: Rows of turns that one wave should hold at least.
WAVE_ROWS = 5_000_000


def done_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, files_key, settings, wave) of all commits; of a shard committed twice, by runs at one time, one counts."""
    if not exists(spark, f"{path}/done"):
        return spark.createDataFrame([], DONE)
    log = stored(spark.read.schema(DONE).parquet(f"{path}/done"), "shards-done")
    return log.groupBy(*KEYS).agg(F.max("wave").alias("wave"))


def waves(shards: list[tuple[str, int]], wave_rows: int) -> Iterator[list[str]]:
    """Shards, in order, in waves of at least ``wave_rows`` rows."""
    wave, rows = [], 0
    for shard, n in sorted(shards):
        wave.append(shard)
        rows += n
        if rows >= wave_rows:
            yield wave
            wave, rows = [], 0
    if wave:
        yield wave


def run(spark: SparkSession, path: str, current: DataFrame, turns: DataFrame, scorer: Scorer, settings: str, wave_rows: int = WAVE_ROWS, committed: Callable[[list[str]], None] = lambda _: None) -> DataFrame:
    """Sums of all current shards, of which only those without a commit are scored. ``current``: (shard, files_key).

    ``turns`` has shard, file, pos and the turn columns. ``committed`` is called with the shards of each wave, once they are safe.
    The list of shards goes through the driver; it is as long as the list of files, which the driver holds for any scan.
    """
    current = stored(current.select("shard", "files_key").withColumn("settings", F.lit(settings)), "shards-current")
    stale = stored(current.join(done_shards(spark, path), KEYS, "left_anti"), "shards-stale")
    sizes = turns.join(F.broadcast(stale.select("shard")), "shard", "left_semi").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    for wave in waves([(r["shard"], r["n"] or 0) for r in stale.join(sizes, "shard", "left").select("shard", "n").collect()], wave_rows):
        name = uuid.uuid4().hex
        shard_sums(turns.filter(F.col("shard").isin(wave)), scorer).write.parquet(f"{path}/waves/{name}")
        commit = stale.filter(F.col("shard").isin(wave)).withColumn("wave", F.lit(name))
        commit.coalesce(1).write.mode("append").parquet(f"{path}/done")
        committed(wave)
    return sums(spark, path, current)


def sums(spark: SparkSession, path: str, current: DataFrame) -> DataFrame:
    """The committed sums of the current shards (shard, files_key, settings)."""
    valid = done_shards(spark, path).join(current, KEYS, "left_semi")
    read = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/waves")
    rows = read.withColumn("wave", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]*)/[^/]*\z", 1))
    return rows.join(valid, ["shard", "wave"]).drop("wave")
