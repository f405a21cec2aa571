"""Exact dedup with counting quotient filters.

Every partition turns the 64-bit fingerprints of its normalised texts into counting quotient filters, one for
each segment of the fingerprint space (and each 4 million fingerprints of a very large partition). Filters of one segment merge losslessly by walking their sorted
remainders and adding counts. Only fingerprints with a merged count above one are suspects; their texts are
compared byte by byte, as grouping keys with map-side combine, so a group of copies that holds a third of all
rows crosses the network once per task.

Texts are equal when identical after each run of white space becomes one space. Null counts as empty. The
row with the smallest doc_id of a group stays; a null doc_id comes last; rows that repeat a doc_id are told
apart by their place, so exactly one row of a group stays. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.parallelism import spread
from lectern.plans.scratch import stored

WHITE = r"[\x20\x09-\x0D]+"
#: Fingerprints that one merged segment is planned to hold, and that a task gathers before it makes filters.
SEGMENT_FINGERPRINTS = 1 << 21
HELD_FINGERPRINTS = 1 << 22
BROADCAST_ROWS = 200_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


@dataclass
class CountingQuotientFilter:
    """Fingerprints of ``bits`` bits as quotient (place) and remainder (value), with counts.

    ``occupied`` has a bit for each quotient, ``runs`` the length of each occupied quotient's run, and
    ``remainders`` the runs one after another, each sorted. Quotient and remainder together are the whole
    fingerprint, so filters with different quotient sizes still merge without loss.
    """

    bits: int
    quotient_bits: int
    occupied: np.ndarray
    runs: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints."""
        quotient_bits = min(bits, max(3, int(len(fingerprints)).bit_length()))
        shift = np.uint64(bits - quotient_bits)
        quotients = (fingerprints >> shift).astype(np.int64)
        present, runs = np.unique(quotients, return_counts=True)
        occupied = np.zeros(1 << quotient_bits, dtype=bool)
        occupied[present] = True
        remainders = fingerprints & ((np.uint64(1) << shift) - np.uint64(1))
        return cls(bits, quotient_bits, np.packbits(occupied), runs, remainders, counts.astype(np.int64))

    def fingerprints(self) -> np.ndarray:
        """Sorted, as quotients ascend and remainders ascend in each run."""
        present = np.flatnonzero(np.unpackbits(self.occupied)).astype(np.uint64)
        return (np.repeat(present, self.runs) << np.uint64(self.bits - self.quotient_bits)) | self.remainders

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        fingerprints = np.concatenate([f.fingerprints() for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(fingerprints, kind="stable")  # merges the sorted runs
        fingerprints, counts = fingerprints[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], fingerprints[1:] != fingerprints[:-1])))
        return cls.build(fingerprints[first], np.add.reduceat(counts, first), filters[0].bits)

    def row(self, segment: int) -> tuple:
        """Packed: remainders in as many bytes as their bits need, runs and counts in as many as the largest needs."""
        parts = (_packed(self.runs), _packed(self.remainders), _packed(self.counts))
        return (segment, self.bits, self.quotient_bits, len(self.counts), self.occupied.tobytes(), *parts)

    @classmethod
    def of(cls, r) -> CountingQuotientFilter:
        occupied = np.frombuffer(r.occupied, np.uint8)
        runs = _unpacked(r.runs, int(np.unpackbits(occupied).sum()))
        return cls(int(r.bits), int(r.quotient_bits), occupied, runs.astype(np.int64), _unpacked(r.remainders, int(r.size)), _unpacked(r.counts, int(r.size)).astype(np.int64))


def _packed(values: np.ndarray) -> bytes:
    """Little-endian values in the fewest whole bytes that hold the largest."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    wide = np.zeros((size, 8), np.uint8)
    if size:
        wide[:, : len(data) // size] = np.frombuffer(data, np.uint8).reshape(size, -1)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


FILTER_SCHEMA = "segment long, bits int, quotient_bits int, size int, occupied binary, runs binary, remainders binary, counts binary"


def repeated_fingerprints(fingerprints: DataFrame, segment_size: int = SEGMENT_FINGERPRINTS) -> DataFrame:
    """(fp, copies) of the fingerprints, column ``fp``, that occur more than once."""
    rows = fingerprints.count()
    segment_bits = max(0, (rows // segment_size).bit_length())
    bits = 64 - segment_bits

    def partition_filters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch["fp"].to_numpy(np.int64).view(np.uint64))
            if sum(map(len, held)) >= HELD_FINGERPRINTS:
                yield filters_of(np.concatenate(held))
                held = []
        if held:
            yield filters_of(np.concatenate(held))

    def filters_of(fingerprints: np.ndarray) -> pd.DataFrame:
        fps, counts = np.unique(fingerprints, return_counts=True)
        segments = (fps >> np.uint64(bits)).astype(np.int64) if segment_bits else np.zeros(len(fps), np.int64)
        low = fps & np.uint64((1 << bits) - 1)
        edges = np.flatnonzero(np.concatenate(([True], segments[1:] != segments[:-1], [True]))) if len(fps) else []
        made = [
            CountingQuotientFilter.build(low[a:b], counts[a:b], bits).row(int(segments[a]))
            for a, b in zip(edges[:-1], edges[1:], strict=True)
        ]
        return pd.DataFrame(made, columns=[c.split()[0] for c in FILTER_SCHEMA.split(", ")])

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.of(r) for r in rows.itertuples()])
        again = whole.counts > 1
        fps = whole.fingerprints()[again]
        if segment_bits:
            fps = fps | (np.uint64(key[0]) << np.uint64(bits))
        return pd.DataFrame({"fp": fps.view(np.int64), "copies": whole.counts[again]})

    filters = fingerprints.select("fp").mapInPandas(partition_filters, FILTER_SCHEMA)
    return filters.groupBy("segment").applyInPandas(merged, "fp long, copies long")


def duplicates(documents: DataFrame) -> DataFrame:
    """One row per input row: row, doc_id, keep_id, group_size, kept, text_sha256."""
    text = normalised(F.col("text"))
    digests = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("t"))
    digests = stored(digests.select("row", "doc_id", F.xxhash64("t").alias("fp"), F.sha2("t", 256).alias("text_sha256")), "dedup-digests")
    suspects = small_or_shuffled(stored(repeated_fingerprints(digests), "dedup-suspects").select("fp"), BROADCAST_ROWS)

    texts = documents.select("doc_id", text.alias("t")).select("doc_id", "t", F.xxhash64("t").alias("fp"))
    same = texts.join(suspects, "fp", "left_semi").groupBy("fp", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(same.filter("group_size > 1").select("fp", F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size"), "dedup-groups")
    known = small_or_shuffled(groups, BROADCAST_ROWS)

    # The rows that bear the smallest doc_id: one, or several if a doc_id repeats; the first of them stays.
    best = digests.join(known, ["fp", "text_sha256"]).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    best = best.groupBy("fp", "text_sha256").agg(F.min("row").alias("keep_row"))
    known = small_or_shuffled(stored(groups.join(best, ["fp", "text_sha256"]), "dedup-kept"), BROADCAST_ROWS)
    joined = digests.join(known, ["fp", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "row", "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(documents: DataFrame) -> DataFrame:
    """The documents, all their columns, without later copies.

    The rows to drop are found by doc_id and text. Rows that repeat both are one row here: one stays.
    """
    text = normalised(F.col("text"))
    found = duplicates(documents)
    gone = found.filter("group_size > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept")
    gone = gone.groupBy("_id", "_sha").agg(F.max("kept").alias("_any_kept"), F.count(F.lit(1)).alias("_n"))
    gone = stored(gone.filter("_n > 1 OR NOT _any_kept"), "dedup-gone")
    rows_repeat = gone.filter("_n > 1").limit(1).count() > 0
    gone = small_or_shuffled(gone, BROADCAST_ROWS)
    marked = documents.withColumn("_text_sha", F.sha2(text, 256))
    joined = marked.join(gone, marked["doc_id"].eqNullSafe(gone["_id"]) & (marked["_text_sha"] == gone["_sha"]), "left")
    single = joined.filter("_n IS NULL").select(*[documents[c] for c in documents.columns])
    if not rows_repeat:
        return single
    # Several rows with one doc_id and one text, of which one may stay: any, as they are equal there.
    several = joined.filter("_n > 1 AND _any_kept")
    several = several.dropDuplicates(["doc_id", "_text_sha"]).select(*[documents[c] for c in documents.columns])
    return single.unionByName(several)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
