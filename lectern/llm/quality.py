"""Quality classifier: logistic regression over hashed word n-grams, fitted with FTRL-proximal.

Features are hashed unigrams and bigrams of words and of punctuation runs, valued count / sqrt(n-grams of the
text). Fitting takes a bounded, hash-chosen sample of labelled rows (``TRAIN_ROWS``): each of ``SHARDS`` shards
runs follow-the-regularised-leader over its rows from the common state, the states are averaged, and that is
repeated ``EPOCHS`` times. A score is a sparse dot product: the weights a text's n-grams pick are summed, many
texts at once. The weight vector is ``1 << BUCKET_BITS`` long, so its broadcast is bounded.

Null and empty texts score by the intercept. Repeated labels of one doc_id count as 1 if at least half say 1.
Null doc_ids have no label and are not held out. Without labels every score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.blocks import U, WORDS_AND_MARKS, mix, ngram_hashes, word_blocks
from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.parallelism import spread
from lectern.plans.scratch import stored

BUCKET_BITS = 18
TRAIN_ROWS = 20_000
SHARDS = 8
EPOCHS = 4
#: The bigram of a word with itself is one feature, whatever the word.
SAME_AGAIN = U(0x51ED270B9F3A7C15)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01


def text_features(words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its text) of one block."""
    bounds = words.bounds
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    pairs = ngram_hashes(words.hashes, 2)
    pairs = np.where(words.hashes[1:] == words.hashes[:-1], SAME_AGAIN, pairs)
    same = text[1:] == text[:-1] if len(text) else np.zeros(0, bool)
    hashes = np.concatenate((mix(words.hashes), pairs[same] if len(pairs) else pairs))
    owner = np.concatenate((text, text[:-1][same] if len(text) else text))
    assert bounds[-1] == len(words.hashes)
    return (hashes >> U(64 - BUCKET_BITS)).astype(np.int64), owner


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in word_blocks(batch.column(1), WORDS_AND_MARKS):
            bucket, owner = text_features(words)
            key, count = np.unique(owner << BUCKET_BITS | bucket, return_counts=True)
            owner, bucket = key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)
            total = np.bincount(owner, weights=count, minlength=len(words.counts))
            value = (count / np.sqrt(np.maximum(total[owner], 1))).astype(np.float32)
            cuts = np.searchsorted(owner, np.arange(1, len(words.counts)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(words.first, len(words.counts)), batch.column(2).slice(words.first, len(words.counts)),
                    pa.array([b.astype(np.int32).tobytes() for b in np.split(bucket, cuts)], pa.binary()),
                    pa.array([v.tobytes() for v in np.split(value, cuts)], pa.binary()),
                ],
                names=["label", "place", "buckets", "val"],
            )


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl_pass(z: np.ndarray, n: np.ndarray, rows: pd.DataFrame) -> None:
    """One pass of FTRL-proximal over the rows, in place; the last place of z and n is the intercept."""
    for label, buckets, value in zip(rows["label"], rows["buckets"], rows["val"], strict=True):
        i = np.append(np.frombuffer(buckets, np.int32), len(z) - 1)
        x = np.append(np.frombuffer(value, np.float32), 1.0)
        w = weights(z[i], n[i])
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
        z[i] += g - sigma * w
        n[i] += g * g


def _shard_pass(state):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        z, n = (a.copy() for a in state.value)
        ftrl_pass(z, n, shard.sort_values(["place", "label"]))
        return pd.DataFrame({"rows": [len(shard)], "z": [z.tobytes()], "n": [n.tobytes()]})

    return run


def fit(labelled: DataFrame, max_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights, intercept last. ``labelled``: doc_id, text, label (0 or 1)."""
    size = (1 << BUCKET_BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    rows = labelled.count()
    if not rows:
        return z
    place = F.xxhash64("doc_id", F.length("text"))
    sample = labelled.select(F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text"), place.alias("place"))
    sample = sample.filter(F.pmod("place", F.lit(1_000_003)) < 1_000_003 * min(1.0, max_rows / rows))
    features = stored(sample.mapInArrow(_feature_batches, "label int, place long, buckets binary, val binary"), "quality-features")
    features = features.withColumn("shard", F.pmod("place", F.lit(SHARDS)))
    for _ in range(EPOCHS):
        shard_pass = _shard_pass(labelled.sparkSession.sparkContext.broadcast((z, n)))
        states = features.groupBy("shard").applyInPandas(shard_pass, "rows long, z binary, n binary").collect()
        share = np.array([s["rows"] for s in states], float) / sum(s["rows"] for s in states)
        z = sum(k * np.frombuffer(s["z"]) for k, s in zip(share, states, strict=True))
        n = sum(k * np.frombuffer(s["n"]) for k, s in zip(share, states, strict=True))
    return weights(z, n)


def _score_batches(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = broadcast.value
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for words in word_blocks(batch.column(text), WORDS_AND_MARKS):
                bucket, owner = text_features(words)
                size = len(words.counts)
                total = np.maximum(np.bincount(owner, minlength=size), 1)
                margin = np.bincount(owner, weights=w[bucket], minlength=size) / np.sqrt(total) + w[-1]
                score = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
                rest = batch.slice(words.first, size)
                yield pa.RecordBatch.from_arrays(
                    [*(c for k, c in enumerate(rest.columns) if k != text), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=[*(f.name for k, f in enumerate(rest.schema) if k != text), "score", "predicted"],
                )

    return run


def score(documents: DataFrame, w: np.ndarray, *keep: str) -> DataFrame:
    """``keep`` columns of every row, score and predicted."""
    broadcast = documents.sparkSession.sparkContext.broadcast(w)
    chosen = documents.select(*keep, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text")
    return chosen.mapInArrow(_score_batches(broadcast), f"{fields}, score double, predicted int")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def labelled_texts(documents: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, label) for a hash-chosen sample of about ``max_rows`` labelled, not held-out doc_ids.

    The sample's ids are bounded by the parameter, so they are broadcast, once counted, to the scan of the documents.
    """
    marks = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out())
    marks = marks.groupBy("doc_id").agg(F.avg("quality").alias("mean")).select("doc_id", (F.col("mean") >= 0.5).cast("int").alias("label"))
    share = min(1.0, max_rows / max(1, marks.count()))
    marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < 1_000_003 * share)
    return documents.select("doc_id", "text").join(small_or_shuffled(stored(marks, "quality-marks"), 2 * max_rows), "doc_id")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    documents = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    w = fit(labelled_texts(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(documents.withColumn("held_out", held_out()), w, "doc_id", "held_out")
