"""Writers of derived tables: CSV and JSON exports, annotation batches, run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.agreement import FIELDS
from lectern.operators.metrics import primary_boundary_year, source_ranges
from lectern.operators.sampling import slices


def write_table(rows: DataFrame, path: str, csv: bool = True) -> None:
    """Parquet, and beside it CSV with a header (aggregates are small; partitions stay as they are)."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}.parquet")
    if csv:
        rows.write.mode("overwrite").option("header", "true").csv(f"{path}.csv")


def json_records(rows: DataFrame) -> DataFrame:
    """One JSON object a row; nulls are written out, NaN counts as null."""
    clean = [F.nanvl(c, F.lit(None).cast("double")).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    json_records(rows).write.mode("overwrite").text(path)


def source_metadata(table: DataFrame) -> DataFrame:
    """One row: the ranges of each source, and the first year in which the later source leads."""
    ranges = source_ranges(table).agg(F.array_sort(F.collect_list(F.struct("source", "min_congress", "max_congress", "min_year", "max_year", "rows"))).alias("sources"))
    year = primary_boundary_year(table)
    return ranges.withColumn("_one", F.lit(1)).join(year.withColumn("_one", F.lit(1)), "_one").drop("_one")


def write_source_metadata(table: DataFrame, path: str) -> None:
    write_json(source_metadata(table), path)


def write_annotation_batches(sample: DataFrame, path: str, size: int = 50) -> None:
    """CSV batches of ``size`` rows in id order, one folder a batch, with blank label columns."""
    blank = [F.lit("").alias(f) for f in (*FIELDS, "confidence", "rationale")]
    rows = slices(sample, "sample_id", size).select("*", *blank)
    rows.write.mode("overwrite").partitionBy("batch").option("header", "true").option("quoteAll", "true").option("multiLine", "true").csv(path)


def manifest_rows(granules: DataFrame) -> DataFrame:
    """Manifest lines of stored granules: ids must be safe as path parts."""
    ok = F.col("granule_id").rlike(r"\A[A-Za-z0-9._-]+\z")
    gid = F.when(ok, F.col("granule_id")).otherwise(F.raise_error(F.concat(F.lit("unsafe id "), "granule_id")))
    folder = F.concat_ws("/", F.substring("date", 1, 4), F.substring("date", 6, 2), gid)
    return granules.select(gid.alias("granuleId"), F.col("date").alias("dateIssued"), F.concat(folder, F.lit(".txt")).alias("txt_path"), F.concat(folder, F.lit(".xml")).alias("mods_path"), F.col("congress").cast("string").alias("congress"))
