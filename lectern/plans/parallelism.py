"""Spread a small scan over the cores before work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(scan: DataFrame) -> DataFrame:
    """``scan``, dealt out anew if fewer of its partitions than the cluster has cores hold rows.

    Give it a table as read, without a shuffle in its plan: the row groups are counted by a job that reads no
    column. A table of a few row groups is read by as few tasks, however many cores wait. Tables worth a cluster
    have more row groups than cores and pass unchanged.
    """
    if scan.isStreaming:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    busy = scan.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).count()
    return scan.repartition(cores) if busy < cores else scan
