"""Exact substring dedup over word windows, partitioned by super-k-mers.

Each window of ``window`` consecutive words has a minimiser: the place of the smallest hash among its
``seed``-word grams. Consecutive windows with the minimiser at the same place form a super-k-mer. Equal
windows have equal minimiser grams, so a window can only repeat within its minimiser's bucket: super-k-mers
whose minimiser occurs once are done with. The others travel to their bucket as one packed string each
(equal strings once, with their count), where all their windows are sorted and counted as strings, exactly.

A minimiser with more distinct packed strings than ``HOT_STRINGS`` would make a large bucket; its windows are
counted by the window itself instead, a grouping with map-side combine, so no bucket grows with one phrase.

Null texts have no words. Windows are judged on the input. doc_ids may be null or repeat: occurrences are told
apart by doc_id and text, and rows that repeat both get the same result. doc_ids must be whole numbers, or strings
of such. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.blocks import U, inverse_powers, mix, ngram_hashes, powers, word_blocks
from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.parallelism import spread
from lectern.plans.scratch import stored

WINDOW_WORDS = 35
#: Words of a minimiser gram; window - seed + 1 must not exceed 63, as flags of a super-k-mer are one long.
SEED_WORDS = 12
HOT_STRINGS = 4_000
BUCKET_STRINGS = 20_000
BROADCAST_ROWS = 200_000

SUPERKMER_SCHEMA = "doc_id long, text_key long, start int, n int, minimiser long, body long"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def superkmers(words, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text, start word in it, windows, minimiser hash, hash of all its words) of one block's super-k-mers."""
    hashes, bounds = words.hashes, words.bounds
    if len(hashes) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = ngram_hashes(hashes, seed)
    place_bits = U(max(20, int(len(grams)).bit_length()))
    mask = (U(1) << place_bits) - U(1)
    best = sliding_min((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), window - seed + 1)
    place = (best & mask).astype(np.int64)
    starts = np.arange(len(best))
    text = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + window <= bounds[text + 1]
    starts, text, place = starts[inside], text[inside], place[inside]
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate((first, [len(starts)])))
    begin, text = starts[first], text[first]
    # Hash of words begin .. begin + n + window - 2, whatever their place: prefix sums times the inverse power of begin.
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(len(hashes))[: len(hashes)], dtype=np.uint64)))
    length = n + window - 1
    body = (prefix[begin + length] - prefix[begin]) * inverse_powers(len(hashes))[begin]
    return text + words.first, begin - bounds[text], n, grams[place[first]], mix(body + length.astype(np.uint64) * U(0xA24BAED4963EE407))


def _superkmer_batches(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for words in word_blocks(batch.column(2)):
                text, start, n, minimiser, body = superkmers(words, window, seed)
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take), keys.take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
                        pa.array(minimiser.astype(np.uint64).view(np.int64)), pa.array(body.astype(np.uint64).view(np.int64)),
                    ],
                    names=["doc_id", "text_key", "start", "n", "minimiser", "body"],
                )

    return run


def _packed(window: int):
    """Cut the packed strings of the wanted super-k-mers out of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                words = text.encode().split()
                rows += [(w["minimiser"], w["body"], w["n"], w["copies"], b" ".join(words[w["start"] : w["start"] + w["n"] + window - 1])) for w in wanted]
            yield pd.DataFrame(rows, columns=["minimiser", "body", "n", "copies", "packed"])

    return run


def _windows(packed: bytes, n: int, window: int) -> list[bytes]:
    words = packed.split()
    return [b" ".join(words[i : i + window]) for i in range(n)]


def _count_bucket(window: int):
    """Sort the windows of a bucket's packed strings and flag those that occur more than once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["minimiser", "body", "n"])  # rows that repeat doc_id and text
        entries = []
        for i, (packed, n, copies) in enumerate(zip(rows["packed"], rows["n"], rows["copies"], strict=True)):
            entries += [(w, i, k, copies) for k, w in enumerate(_windows(packed, n, window))]
        entries.sort()
        flags = [0] * len(rows)
        lo = 0
        while lo < len(entries):
            hi, total = lo, 0
            while hi < len(entries) and entries[hi][0] == entries[lo][0]:
                total += entries[hi][3]
                hi += 1
            if total > 1:
                for _, i, k, _ in entries[lo:hi]:
                    flags[i] |= 1 << k
            lo = hi
        out = pd.DataFrame({"minimiser": rows["minimiser"], "body": rows["body"], "flags": pd.Series(flags, dtype="int64", index=rows.index)})
        return out[out["flags"] != 0]

    return run


def _explode_windows(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (m, b, k, c, w)
                for m, b, n, c, p in zip(batch["minimiser"], batch["body"], batch["n"], batch["copies"], batch["packed"], strict=True)
                for k, w in enumerate(_windows(p, n, window))
            ]
            yield pd.DataFrame(rows, columns=["minimiser", "body", "k", "copies", "w"])

    return run


def repeated_ranges(documents: DataFrame, window: int = WINDOW_WORDS, seed: int = SEED_WORDS, hot: int = HOT_STRINGS) -> DataFrame:
    """(doc_id, text_key, ranges): array of (start, flags), bit k of flags: the window at word start + k repeats."""
    assert window - seed + 1 <= 63
    docs = documents.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    found = stored(docs.mapInArrow(_superkmer_batches(window, seed), SUPERKMER_SCHEMA), "substring-superkmers")

    shared = found.groupBy("minimiser").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("minimiser")
    shared = stored(shared, "substring-shared")  # so that the join below is one that Spark splits at hot keys
    live = stored(found.join(shared, "minimiser", "left_semi"), "substring-live")
    # One occurrence stands for all equal packed strings. (No struct in min(): that would sort.)
    distinct = live.groupBy("minimiser", "body", "n").agg(F.count(F.lit(1)).alias("copies"), F.min(F.xxhash64("doc_id", "text_key", "start")).alias("pick"))
    one = live.withColumn("pick", F.xxhash64("doc_id", "text_key", "start")).join(distinct, ["minimiser", "body", "n", "pick"])
    wanted = one.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n", "minimiser", "body", "copies")).alias("wanted"))
    at = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["text_key"] == wanted["text_key"])
    packed = docs.join(wanted, at).select("text", "wanted").mapInPandas(_packed(window), "minimiser long, body long, n int, copies long, packed binary")
    packed = stored(packed, "substring-packed")

    strings = packed.groupBy("minimiser").agg(F.count(F.lit(1)).alias("s"))
    crowded = small_or_shuffled(stored(strings.filter(F.col("s") > hot).select("minimiser"), "substring-hot"), BROADCAST_ROWS)
    cool = packed.join(crowded, "minimiser", "left_anti")
    buckets = max(1, cool.count() // BUCKET_STRINGS + 1) * 4
    counted = cool.groupBy(F.pmod(F.hash("minimiser"), F.lit(buckets)).alias("bucket")).applyInPandas(
        lambda rows: _count_bucket(window)(rows), "minimiser long, body long, flags long"
    )
    single = packed.join(crowded, "minimiser", "left_semi").dropDuplicates(["minimiser", "body", "n"])
    single = single.mapInPandas(_explode_windows(window), "minimiser long, body long, k int, copies long, w binary")
    single = stored(single, "substring-single")
    again = single.groupBy("w").agg(F.sum("copies").alias("c")).filter("c > 1").select("w")
    hot_flags = single.join(again, "w", "left_semi").groupBy("minimiser", "body").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("flags"))
    flags = counted.unionByName(hot_flags)

    ranges = live.join(flags, ["minimiser", "body"]).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "flags")).alias("ranges"))
    return stored(ranges, "substring-ranges")


def _removed(words: list, ranges, window: int) -> np.ndarray:
    """Mask of the words that a flagged window covers."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for r in ranges if ranges is not None else ():
        start, flags, k = int(r["start"]), int(r["flags"]), 0
        while flags:
            if flags & 1:
                change[start + k] += 1
                change[start + k + window] -= 1
            flags, k = flags >> 1, k + 1
    return np.cumsum(change[:-1]) > 0


def _rewrite(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()
                gone = _removed(words, ranges.as_py(), window)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if n_removed[-1] else b" ".join(words))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(documents: DataFrame, window: int = WINDOW_WORDS, seed: int = SEED_WORDS, hot: int = HOT_STRINGS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    ranges = repeated_ranges(documents, window, seed, hot).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    joined = docs.join(ranges, docs["doc_id"].eqNullSafe(ranges["_id"]) & (docs["text_key"] == ranges["_key"]), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(_rewrite(window), "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 35], ' ') AS s FROM d, unnest(range(0, greatest(len(w) - 34, 0))) t(i)),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM win JOIN again USING (s), unnest(range(i, i + 35)) t(p)),
g AS (SELECT doc_id, count(*) AS n_removed, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ps, k - 1)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
