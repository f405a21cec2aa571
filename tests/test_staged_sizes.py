"""What a staged run writes: no task and no file grows with the rows of one partition value."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lectern.sources import observed, staged


def test_one_value_is_written_and_digested_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staged, "FILE_ROWS", 1_000, raising=False)
    root, n = f"file://{tmp_path}/t", 20_000
    rows = spark.range(n).select(F.concat(F.lit("t"), F.lit(1)).alias("turn_id"), F.lit(118).alias("congress"), F.lit("D").alias("party"), F.lit(False).alias("is_procedural"), F.lit(1).alias("word_count"))
    counts = observed.publish_observed(rows, root)  # all rows equal: a hash of them would not part them
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{tmp_path}/t/runs/**/*.parquet", recursive=True)]
    assert sum(sizes) == counts["rows"] == counts["total_turns"] == n and max(sizes) <= 2_000
    assert staged.verify(spark, root) == len(sizes) and staged.read(spark, root).count() == n


def test_long_texts_make_files_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staged, "FILE_BYTES", 100_000, raising=False)
    root = f"file://{tmp_path}/t"
    staged.publish(spark.range(100).select(F.when(F.col("id") < 90, 1).alias("congress"), F.repeat(F.lit("x"), 10_000).alias("v")), root, "congress")
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{tmp_path}/t/runs/**/*.parquet", recursive=True)]
    assert sum(sizes) == 100 and max(sizes) <= 20
    assert staged.read(spark, root).groupBy("congress").count().orderBy("congress").collect() == [(None, 10), (1, 90)]
