"""Reading and writing turn tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.dedup import keep_first, source_rank
from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.scratch import stored
from lectern.schema import TURN, conform


def read_turns(spark: SparkSession, *paths: str) -> DataFrame:
    """Turn files of any vintage: absent columns are null; ``file``, ``source_rank`` and ``pos`` give the reading order."""
    raw = spark.read.option("mergeSchema", "true").parquet(*paths)
    have = set(raw.columns)
    columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TURN]
    name = F.col("_metadata.file_name")
    return raw.select(*columns, name.alias("file"), source_rank(name).alias("source_rank"), F.col("_metadata.row_index").alias("pos"))


def write_turns(turns: DataFrame, path: str, mode: str = "append") -> None:
    """zstd Parquet, one folder a congress; in overwrite mode only the congresses that ``turns`` has are replaced."""
    rows = conform(turns).withColumn("congress_key", F.col("congress"))
    writer = rows.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("congress_key").parquet(path)


def append_new(turns: DataFrame, path: str) -> int:
    """Append the turns whose id the table lacks; returns how many. A missing table counts as empty.

    Of new rows of one id the first in reading order (source_rank, file, pos, where ``turns`` has them) stays, then the first by content.
    """
    known = load_partitions(turns.sparkSession, path)
    order = [F.col(c) for c in ("source_rank", "file", "pos") if c in turns.columns]
    fresh = keep_first(turns, ["turn_id"], [*order, F.to_json(F.struct(*sorted(turns.columns)))])
    fresh = stored(conform(fresh if known is None else fresh.join(known.select("turn_id"), "turn_id", "left_anti")), "append-new")
    write_turns(fresh, path)
    return fresh.count()


def publish_packages(turns: DataFrame, requested: DataFrame, path: str, manifest_path: str) -> dict:
    """All-or-nothing merge of package turns (with a ``package`` column), with a manifest row a run.

    Each ``package`` of ``requested`` must have turns; otherwise nothing is published and the manifest says which
    packages failed. The write itself is one Spark job, whose commit makes all of it visible or none. The manifest
    has time, counts, failed packages and the digest of the published rows by congress.
    """
    spark = turns.sparkSession
    rows = stored(turns, "publish-packages")
    failed = sorted(r[0] for r in requested.select("package").distinct().join(rows.select("package").distinct(), "package", "left_anti").collect())
    asked = requested.select("package").distinct().count()
    fresh = 0 if failed else append_new(rows.drop("package"), path)
    digest = rows.groupBy("congress").agg(F.count(F.lit(1)).alias("turns"), F.sha2(F.sum(F.xxhash64("turn_id", "text").cast("decimal(38,0)")).cast("string"), 256).alias("digest"))
    outputs = [] if failed else [r.asDict() for r in digest.orderBy("congress").collect()]  # one row a congress
    run = {"requested": asked, "successful": asked - len(failed), "failed_or_empty": failed, "new_turns": fresh, "published": not failed, "outputs": outputs}
    schema = "requested long, successful long, failed_or_empty array<string>, new_turns long, published boolean, outputs array<struct<congress:int,turns:long,digest:string>>"
    spark.createDataFrame([tuple({**run, "outputs": [tuple(o.values()) for o in outputs]}.values())], schema).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(manifest_path)
    if failed:
        raise ValueError(f"{len(failed)} packages failed or had no turns; nothing was published: {failed[:5]}")
    return run


def changed_partitions(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """Keys whose content differs, by an order-free hash of their rows; decides which partitions to rewrite."""

    def digest(rows: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")
        return rows.groupBy(key).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s")).alias(name))

    fresh = digest(new, "fresh")
    if old is None:
        return fresh.select(key)
    kept = digest(old.select(*new.columns), "kept").withColumnRenamed(key, "_key")
    joined = fresh.join(kept, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.filter(~F.col("fresh").eqNullSafe(F.col("kept"))).select(key)


def save_partitions(old: DataFrame | None, new: DataFrame, key: str, path: str) -> list:
    """Rewrite only the partitions that changed; returns their keys (one a partition folder, so few)."""
    changed = stored(changed_partitions(old, new, key), "changed-partitions")
    keys = sorted((r[0] for r in changed.collect()), key=lambda k: (k is not None, k))
    on = F.col(f"new.{key}").eqNullSafe(F.col(f"changed.{key}"))
    rows = new.alias("new").join(small_or_shuffled(changed, 100_000).alias("changed"), on, "left_semi").withColumn(f"{key}_key", F.col(key))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(f"{key}_key").parquet(path)
    return keys


def load_partitions(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None if there is none or it is empty."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    return rows if rows.limit(1).count() else None


def date_bounds(rows: DataFrame, date: str) -> DataFrame:
    """First and last date, by a scan of that one column.

    Footers cannot answer: dates are strings, whose Parquet statistics may be cut short, so Spark does not push their
    minimum and maximum down.
    """
    return rows.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def publish(turns: DataFrame, stats: dict[str, int], path: str, stats_path: str | None = None, max_rejected: int = 0) -> dict[str, int]:
    """Replace the congresses that ``turns`` has, unless more than ``max_rejected`` inputs were rejected or nothing came through.

    ``stats`` counts manifest_rows, malformed_json and invalid_rows; they are written, with turns_written, to ``stats_path``.
    """
    rejected = stats.get("malformed_json", 0) + stats.get("invalid_rows", 0)
    if rejected > max_rejected:
        raise ValueError(f"{rejected} of {stats.get('manifest_rows', 0)} inputs rejected (limit {max_rejected})")
    rows = stored(conform(turns), "publish")
    written = stats | {"turns_written": rows.count()}
    if not written["turns_written"]:
        raise ValueError("no turns to publish")
    write_turns(rows, path, mode="overwrite")
    if stats_path is not None:
        turns.sparkSession.createDataFrame([tuple(written.values())], [*written]).coalesce(1).write.mode("overwrite").json(stats_path)
    return written


def load_bills(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored bill table, checked and normalised; None if there is none or it is empty."""
    from lectern.operators.bills import normalized

    rows = load_partitions(spark, path)
    return None if rows is None else normalized(rows.drop("congress_key"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation batches (CSV with header, quoted line breaks) with labels in lower case.

    A label outside its vocabulary, a blank rationale or a blank or repeated id fails the read and is named.
    """
    from lectern.operators.agreement import clean_labels, one_a_key, vocabulary_violations

    rows = stored(clean_labels(spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)), "annotations")
    first = vocabulary_violations(rows).orderBy("sample_id", "field").first()
    if first is not None:
        raise ValueError(f"bad {first['field']} {first['value']!r} in sample {first['sample_id']!r}")
    return one_a_key(rows)
