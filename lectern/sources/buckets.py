"""Bucketed turn tables: rows of one id lie in one bucket on disk, so dedup and joins on it need no exchange.

Every table is written once, with one shuffle on its key, and read as often as needed without. All tables of a join need equal
bucket counts; choose them so that a bucket fits a task (about 200 MB). Metadata is in the session's catalog and files in its warehouse,
which all executors share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.dedup import keep_first

BUCKETS = 200


def write_buckets(rows: DataFrame, table: str, key: str | list[str], buckets: int = BUCKETS, mode: str = "overwrite", path: str | None = None) -> None:
    """``rows`` as a table in buckets of ``key``, sorted inside, one file a bucket; at ``path``, or in the warehouse."""
    keys = [key] if isinstance(key, str) else key
    places = {} if path is None else {"path": path}
    rows.repartition(buckets, *keys).write.mode(mode).format("parquet").options(compression="zstd", **places).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def first_of_each(spark: SparkSession, table: str, key: str | list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``: a sort inside each bucket and no exchange."""
    return keep_first(spark.table(table), [key] if isinstance(key, str) else key, order)


def speech_lookups(spark: SparkSession, speeches: str, descriptions: str, speakers: str) -> DataFrame:
    """Speeches with description and speaker from tables in buckets of (congress, speech_id).

    Of several lines of one speech the last, by ``pos``, counts in the two lookup tables. All three sides are read as they lie.
    """
    keys = ["congress", "speech_id"]
    last = [F.col("pos").desc()]
    d, m = (first_of_each(spark, t, keys, last).drop("pos") for t in (descriptions, speakers))
    return spark.table(speeches).join(d.hint("merge"), keys, "left").join(m.hint("merge"), keys, "left")
