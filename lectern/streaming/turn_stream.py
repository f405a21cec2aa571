"""Turns as a stream: score as they arrive, recompute the member-days they touch.

The reference behaviour is batch: append, look-back repair, idempotent upsert. So each micro-batch replaces the
days it touches, from the turn files with each id once, which makes replays and turns of any age harmless and needs no
streaming state, at the cost of a scan a batch. :mod:`lectern.streaming.member_state` keeps state instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.scoring import Scorer
from lectern.operators.dedup import keep_first
from lectern.operators.members import attributed, member_day, score_spoken
from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.scratch import stored
from lectern.schema import TURN


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TURN).option("recursiveFileLookup", "true").parquet(path)


def recompute_days(batch: DataFrame, all_turns: DataFrame, scorer: Scorer) -> DataFrame:
    """Member-days, over all known turns, of the days that ``batch`` has.

    Rows of other days go before anything is shuffled; of repeated ids in what is left the first by date, then by content, stays.
    """
    days = small_or_shuffled(stored(attributed(batch).select("date").distinct(), "stream-days"), 100_000)
    rows = attributed(all_turns).join(days, "date", "left_semi")
    rows = keep_first(rows, ["turn_id"], [F.col("date"), F.to_json(F.struct(*sorted(rows.columns)))])
    return member_day(score_spoken(rows.withColumn("pos", F.col("turn_id")), scorer))


def start(spark: SparkSession, path: str, out: str, checkpoint: str, scorer: Scorer, available_now: bool = True):
    """Keep the member-day table at ``out``, partitioned by day, current with the turn files at ``path``."""

    def apply(batch: DataFrame, _epoch: int) -> None:
        turns = batch.sparkSession.read.schema(TURN).option("recursiveFileLookup", "true").parquet(path)
        days = recompute_days(batch, turns, scorer).withColumn("day_key", F.col("date"))
        days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day_key").parquet(out)

    writer = read_stream(spark, path).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
