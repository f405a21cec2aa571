"""Zone maps: the smallest and largest value of a column in each Parquet file and row group, read from footers.

Spark does not push minima of strings down, as their statistics may be cut short in general. Here the footers are read
in tasks, file by file, and kept as a table, so that questions about a column's range need no scan, and an anti join opens
only files whose range holds a wanted value. A value of 64 bytes or fewer, such as an ISO date, is never cut short. A row
group without statistics has null bounds and counts as one that may hold anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.scratch import stored
from lectern.sources.ranges import list_files, open_ranges
from lectern.sources.turn_files import load_partitions

ZONES = "path string, length long, modified timestamp, row_group int, rows long, nulls long, low string, high string"
BROADCAST_ROWS = 200_000
#: Wanted values and ranges meet in bins of so many leading characters: the month of an ISO date.
BIN = 7


def _text(value) -> str | None:
    """A bound as text; bytes that are no text have none."""
    if isinstance(value, bytes):
        try:
            return value.decode("utf-8")
        except UnicodeDecodeError:
            return None
    return None if value is None else str(value)


def _footers(column: str):
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("row_group", pa.int32()), ("rows", pa.int64()), ("nulls", pa.int64()), ("low", pa.string()), ("high", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length, modified in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with open_ranges(path) as file:
                    footer = pq.read_metadata(file)
                place = next((k for k in range(footer.num_columns) if footer.schema.column(k).path == column), None)
                for g in range(footer.num_row_groups):
                    group = footer.row_group(g)
                    found = group.column(place).statistics if place is not None else None
                    bounds = (_text(found.min), _text(found.max)) if found is not None and found.has_min_max else (None, None)
                    empty = place is None  # a file without the column has only nulls of it
                    nulls = group.num_rows if empty else found.null_count if found is not None and found.has_null_count else None
                    rows.append((path, length, modified, g, group.num_rows, nulls, *bounds))
                if not footer.num_row_groups:
                    rows.append((path, length, modified, -1, 0, 0, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def read_zones(files: DataFrame, column: str) -> DataFrame:
    """A row a row group (ZONES) of the Parquet files (path, length, modificationTime); no data page is read."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "length", "modificationTime").repartition(cores, "path").mapInArrow(_footers(column), ZONES)


def refresh(spark: SparkSession, path: str, column: str, map_path: str) -> DataFrame:
    """The zone map of all files below ``path``, kept at ``map_path``: only files that are new or changed are opened.

    The map is written to a new folder under ``map_path`` before it replaces the last one in its log, so a lost run leaves the last one.
    """
    files = stored(list_files(spark, path, "*.parquet"), "zone-files")
    log = load_partitions(spark, f"{map_path}/log")
    number = 0 if log is None else log.agg(F.max("number")).first()[0] + 1
    zones = None
    if log is not None:
        old = spark.read.schema(ZONES).parquet(f"{map_path}/{number - 1}")
        same = ["path", "length", "modificationTime"]
        kept = old.withColumnRenamed("modified", "modificationTime").join(files, same, "left_semi").withColumnRenamed("modificationTime", "modified")
        fresh = files.join(old.select("path", "length", F.col("modified").alias("modificationTime")).distinct(), same, "left_anti")
        zones = kept.unionByName(read_zones(fresh, column))
    zones = read_zones(files, column) if zones is None else zones
    zones.write.mode("overwrite").parquet(f"{map_path}/{number}")
    spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("append").parquet(f"{map_path}/log")
    return spark.read.schema(ZONES).parquet(f"{map_path}/{number}")


def _some(zones: DataFrame) -> DataFrame:
    """Zones that may hold a value: neither empty nor all null."""
    return zones.filter((F.col("rows") > 0) & ~F.coalesce(F.col("nulls") == F.col("rows"), F.lit(False)))


def bounds(zones: DataFrame) -> DataFrame:
    """One row (low, high, unknown): the range of the column; ``unknown`` row groups have no statistics and are not in it."""
    return _some(zones).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count_if(F.col("low").isNull()).alias("unknown"))


def file_profile(zones: DataFrame) -> DataFrame:
    """Rows, bytes and range of each file, and the number of row groups without statistics; no file is opened."""
    may = F.col("low").isNull() & (F.col("rows") > 0) & ~F.coalesce(F.col("nulls") == F.col("rows"), F.lit(False))
    return zones.groupBy("path").agg(
        F.sum("rows").alias("rows"), F.max("length").alias("bytes"), F.min("low").alias("first"), F.max("high").alias("last"), F.count_if(may).alias("unknown"),
    ).withColumn("file", F.element_at(F.split("path", "/"), -1))


def files_for(zones: DataFrame, wanted: DataFrame, value: str) -> DataFrame:
    """(path) of the files whose range holds one of the wanted values, or that may: each value meets the ranges of its bin alone.

    A range is filed under each month from its first to its last; one that spans no two ISO dates meets all values by a bin of its own.
    """
    some = _some(zones)
    first, last = (F.when(F.col(c).rlike(r"\A\d{4}-\d{2}"), F.concat(F.substring(c, 1, BIN), F.lit("-01")).try_cast("date")) for c in ("low", "high"))
    is_day = first.isNotNull() & last.isNotNull()
    months = F.transform(F.sequence(first, last, F.expr("interval 1 month")), lambda m: F.date_format(m, "yyyy-MM"))
    ranges = some.select("path", "low", "high", F.explode(F.when(is_day, months).otherwise(F.array(F.lit("*")))).alias("bin")).distinct()
    asked = wanted.select(F.col(value).cast("string").alias("value")).filter("value IS NOT NULL").distinct()
    asked = asked.select("value", F.explode(F.array(F.substring("value", 1, BIN), F.lit("*"))).alias("bin"))
    held = F.col("low").isNull() | F.col("value").between(F.col("low"), F.col("high"))
    return ranges.join(small_or_shuffled(stored(asked, "zone-asked"), BROADCAST_ROWS), "bin").filter(held).select("path").distinct()


@dataclass
class Missing:
    """Wanted values that no file has, and how many files it took to know."""

    values: DataFrame
    opened: int
    skipped: int


def missing_values(spark: SparkSession, zones: DataFrame, column: str, wanted: DataFrame, value: str) -> Missing:
    """The wanted values that the column lacks: an anti join that opens only files whose range holds one of them.

    The paths of those files go through the driver, as the paths of any scan do.
    """
    zones = stored(zones, "zones")
    paths = sorted(r["path"] for r in files_for(zones, wanted, value).collect())
    total = zones.select("path").distinct().count()
    asked = wanted.select(value).distinct()
    if not paths:
        return Missing(asked, 0, total)
    present = spark.read.option("mergeSchema", "true").parquet(*paths)
    if column not in present.columns:
        return Missing(asked, len(paths), total - len(paths))
    found = present.select(F.col(column).alias(value)).distinct()
    return Missing(asked.join(found, value, "left_anti"), len(paths), total - len(paths))


def still_failed(errors: DataFrame, zones: DataFrame, column: str = "date") -> Missing:
    """Packages that a log of failures (value: its lines) names and whose day the corpus still lacks, as ``package``.

    A log only grows, so an entry is no proof of a gap: each is looked up, in the files whose range holds its day. Names with an
    impossible date are left out; of several names of one day the last in the log counts.
    """
    names = errors.select(F.monotonically_increasing_id().alias("line"), F.posexplode(F.split("value", r"\s+")).alias("place", "package"))
    day = F.regexp_extract("package", r"\ACREC-(\d{4}-\d{2}-\d{2})", 1)
    dated = names.withColumn("day", day).filter(F.col("day").try_cast("date").isNotNull())
    logged = stored(dated.groupBy("day").agg(F.max_by("package", F.struct("line", "place")).alias("package")), "failed-packages")
    found = missing_values(errors.sparkSession, zones, column, logged, "day")
    return Missing(logged.join(found.values, "day", "left_semi").select("package"), found.opened, found.skipped)
