"""Corpus health: manifest profiles, file profiles, gaps and missing ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.scratch import stored


def manifest_profile(rows: DataFrame, id_: str, date: str, malformed: Column | None = None) -> DataFrame:
    """One row: rows, distinct ids, repeats, malformed lines and date range. Malformed rows count nowhere else."""
    bad = F.coalesce(malformed, F.lit(False)) if malformed is not None else F.lit(False)
    good = ~bad
    out = rows.agg(
        F.count_if(good).alias("rows"), F.count_distinct(F.when(good, F.col(id_))).alias("distinct_ids"), F.count_if(bad).alias("malformed"),
        F.min(F.when(good, F.col(date))).alias("first_date"), F.max(F.when(good, F.col(date))).alias("last_date"),
    )
    return out.withColumn("duplicate_rows", F.col("rows") - F.col("distinct_ids"))


def rows_by_year(rows: DataFrame, date: str) -> DataFrame:
    return rows.groupBy(F.substring(date, 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("rows"))


def file_profile(files: DataFrame, date: str) -> DataFrame:
    """Rows, date range and bytes by file, from file metadata; ``files`` is a file-source DataFrame."""
    named = files.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col(date).alias("d"))
    return named.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.max("bytes").alias("bytes"))


def source_profile(profile: DataFrame) -> DataFrame:
    """By source, which is the file name before its last underscore: files, rows and date range of a file profile."""
    source = F.regexp_replace(F.regexp_replace("file", r"\.parquet\z", ""), r"_[^_]*\z", "")
    return profile.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Wanted keys that are not present."""
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def still_open(all_ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return missing(all_ids, done, key)


def reconcile(checkpoint: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Checkpointed ids that storage really has."""
    return checkpoint.join(stored.select(key).distinct(), key, "left_semi")


def interior_gaps(corpus: DataFrame, manifest: DataFrame, day: str) -> DataFrame:
    """Days of the corpus between the manifest's first and last day that the manifest lacks."""
    lo, hi = manifest.agg(F.min(day), F.max(day)).first()  # literals reach the scan, which skips row groups outside
    return missing(corpus.select(day).filter(F.col(day).between(F.lit(lo), F.lit(hi))).distinct(), manifest, day)


def month_chunks(days: DataFrame) -> DataFrame:
    """(start, end) of each month between the days ``a`` and ``b`` of each row, clipped to them."""
    months = days.select("a", "b", F.explode(F.sequence(F.trunc("a", "month"), F.col("b"), F.expr("interval 1 month"))).alias("m"))
    return months.select(F.greatest("a", "m").alias("start"), F.least("b", F.last_day("m")).alias("end"))


def month_chunks_of(rows: DataFrame, day: Column) -> DataFrame:
    """The months from the first to the last day that a table has."""
    return month_chunks(rows.agg(F.min(day).alias("a"), F.max(day).alias("b")).filter("a IS NOT NULL"))


def known_days(turns: DataFrame, day: str, max_rows: int = 200_000) -> DataFrame:
    return small_or_shuffled(stored(turns.select(day).distinct(), "known-days"), max_rows)
