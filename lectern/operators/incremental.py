"""Incremental recomputation: partial sums by shard in a state table, valid while files and settings stay.

A shard holds all files that may share turn ids, so dedup inside shards equals dedup overall, and the sum of
shard partials equals the full aggregation.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import logging
from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import lexicon as lexicon_module
from lectern.functions import scoring as scoring_module
from lectern.functions import text as text_module
from lectern.functions.scoring import SCORES, Scorer, score_turns
from lectern.operators.dedup import upsert, without_repeats
from lectern.operators.metrics import GROUP, merge_sums, substantive, sum_scores, with_groups
from lectern.plans.scratch import stored

LOG = logging.getLogger(__name__)
#: How a table that is missing or damaged makes itself known.
UNREADABLE = (PySparkException, Py4JJavaError)


def shard_of(file: Column) -> Column:
    """Package files by congress, every other file by itself."""
    stem = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.parquet\z", "")
    congress = F.regexp_extract(stem, r"\Agovinfo.*?_(\d+)\z", 1)
    return F.when(congress != "", F.concat(F.lit("govinfo:"), congress)).otherwise(F.concat(F.lit("file:"), stem))


def settings_fingerprint(scorer: Scorer, **flags) -> str:
    """SHA-256 of all that can change a shard's sums: compiled lexicons, score names, flags and the scoring code.

    The code holds the exclusion, negation and party patterns. Titles and rates of metrics are made from merged
    sums and are left out.
    """
    lexicon = lambda x: [sorted(x.words), x.phrases]
    parts = {k: ({t: lexicon(x) for t, x in v.items()} if isinstance(v, dict) else lexicon(v)) for k, v in vars(scorer).items()}
    code = [inspect.getsource(x) for x in (scoring_module, text_module, lexicon_module, shard_sums, sum_scores, with_groups, substantive)]
    return hashlib.sha256(json.dumps([parts, SCORES, flags, code], sort_keys=True).encode()).hexdigest()


def file_fingerprints(files: DataFrame) -> DataFrame:
    """(shard, files_key) from (path, length, modificationTime): changes if any file of the shard does."""
    one = F.concat_ws(":", F.element_at(F.split("path", "/"), -1), F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    return files.groupBy(shard_of(F.col("path")).alias("shard")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(one)), "|"), 256).alias("files_key"))


def shard_sums(turns: DataFrame, scorer: Scorer, include_procedural: bool = False) -> DataFrame:
    """Partial sums of (shard, file, pos, turn columns): dedup inside shards, then score and sum.

    Repeats are found on ids alone, so texts are not shuffled for it.
    """
    package = F.startswith("shard", F.lit("govinfo:"))
    rows = without_repeats(turns, "turn_id", ["file", "pos"], scope=package)
    rows = rows if include_procedural else substantive(rows)
    return sum_scores(score_turns(with_groups(rows), scorer), ("shard", *GROUP))


def refresh(state: DataFrame | None, current: DataFrame, turns: DataFrame, scorer: Scorer, settings: str) -> DataFrame:
    """The next state table: valid shards of the old one and new sums for the rest. ``current``: (shard, files_key)."""
    current = current.withColumn("settings", F.lit(settings))
    if state is None:
        return shard_sums(turns, scorer).join(current, "shard")
    keys = ["shard", "files_key", "settings"]
    valid = state.join(current, keys, "left_semi")
    stale = current.join(state.select(*keys).distinct(), keys, "left_anti")
    fresh = shard_sums(turns.join(stale.select("shard"), "shard", "left_semi"), scorer).join(stale, "shard")
    return valid.unionByName(fresh)


def save_state(state: DataFrame, path: str) -> None:
    """Store the next state table beside the last one and then name it current, so that a lost run leaves the last one.

    ``path`` holds two slots that take turns, and a small log with the slot, row count and digest of each save.
    """
    spark = state.sparkSession
    log = _state_log(spark, path)
    number = 0 if log is None else (log.agg(F.max("number")).first()[0] or 0) + 1
    state.write.mode("overwrite").parquet(f"{path}/slot{number % 2}")
    rows, digest = _state_digest(spark.read.parquet(f"{path}/slot{number % 2}"))
    spark.createDataFrame([(number, rows, digest)], "number long, rows long, digest string").coalesce(1).write.mode("append").parquet(f"{path}/log")


def load_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The current state table; None if there is none or it is not what was saved, which rescores every shard."""
    log = _state_log(spark, path)
    last = None if log is None else log.orderBy(F.desc("number")).first()
    if last is None:
        return None
    try:
        state = spark.read.parquet(f"{path}/slot{last['number'] % 2}")
        if _state_digest(state) == (last["rows"], last["digest"]):
            return state
        LOG.warning("state at %s differs from what was saved; it is not used", path)
    except UNREADABLE as error:
        LOG.warning("state at %s cannot be read and is not used: %s", path, str(error)[:200])
    return None


def _state_log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return stored(spark.read.schema("number long, rows long, digest string").parquet(f"{path}/log"), "state-log")
    except UNREADABLE:
        return None


def _state_digest(state: DataFrame) -> tuple[int, str]:
    columns = sorted(state.columns)
    rows, total = state.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0))).first()
    return rows, hashlib.sha256(f"{columns} {total}".encode()).hexdigest()


def update_state(spark: SparkSession, path: str, current: DataFrame, turns: DataFrame, scorer: Scorer, settings: str) -> DataFrame:
    """Refresh the stored state: only shards whose files or settings changed are scored; gone shards are pruned."""
    fresh = stored(refresh(load_state(spark, path), current, turns, scorer, settings), "state-next")
    save_state(fresh, path)
    return fresh


def totals(state: DataFrame) -> DataFrame:
    return merge_sums(state)


def merge_member_days(stored: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Recomputed days replace stored ones, so a late repair never counts twice."""
    return fresh if stored is None else upsert(stored, fresh, ["bioguide", "date", "chamber"])


def repair_window(newest: date | None, today: date, look_back: int = 3) -> tuple[date, date]:
    """Days to recompute: from ``look_back`` before the newest stored day through today."""
    return ((newest or today) - timedelta(days=look_back), today)


def next_window(newest: date | None, today: date, first: date) -> tuple[date, date] | None:
    """Days after the newest stored one; None if there are none."""
    start = newest + timedelta(days=1) if newest else first
    return (start, today) if start <= today else None


def routine_congresses(today: date) -> list[int]:
    """The sitting congress, and the one before it in the first two weeks of January of an odd year."""
    now = (today.year - 1789) // 2 + 1
    return [now - 1, now] if today.year % 2 == 1 and (today.month, today.day) <= (1, 14) else [now]
