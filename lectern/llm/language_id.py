"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of each language over all labelled rows, whole texts, smooths them and keeps one
matrix of log probabilities, languages by buckets. Counts travel in slices of buckets, so no task adds up more than one slice
from each of the others. The matrix's size is bounded by ``MAX_LANGUAGES`` x ``BUCKETS``, so it is broadcast; scoring adds up the rows
of the matrix that a text's n-grams pick, in numpy, for many texts at once.

The score is the posterior of the predicted language with evenly likely languages, evidence divided by the
square root of the number of n-grams (they are far from independent). Null texts and texts without a letter
are ``und`` with score 0. A model without labelled rows calls every text ``und``. Ties go to the language that
sorts first.

:func:`drop_foreign` filters with the model: a text must have a letter, and its mean log probability per n-gram in the
predicted language, over its letters alone, must reach that language's floor, the lowest mean of its training texts less ``FLOOR_MARGIN``.
Texts in no learned language and gibberish fall far below it. Without learned languages every text with a letter stays. doc_ids may be null or repeat: rows are scored one by one. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.blocks import U, mix
from lectern.plans.parallelism import spread

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 500
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Log probability per n-gram by which a text may fall below the lowest training text of its language.
FLOOR_MARGIN = 2.0
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Buckets whose counts make one row.
SLICE = 256
#: Code points handled at once.
BLOCK_CHARS = 1 << 18


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, each text with one space before and two after; start of each text and the end)."""
    points = np.frombuffer("".join(f" {t}  " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return points, np.concatenate(([0], np.cumsum([len(t) + 3 for t in texts])))


def bucket_rows(points: np.ndarray, starts: np.ndarray, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that begins at each code point.

    The last place of a text would see into the next text; it gets the empty bucket ``buckets``.
    """
    for order in ORDERS:
        h = np.full(len(points), order, np.uint64)
        for j in range(order):
            h[: len(points) - j] = h[: len(points) - j] * U(0x100000001B3) + points[j:]
        rows = (mix(h) & U(buckets - 1)).astype(np.int64)
        rows[starts[1:] - 1] = buckets
        yield rows


def text_groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of lower-cased texts of about ``BLOCK_CHARS``; null counts as empty."""
    first, group, size = 0, [], 0
    for k in range(len(column)):  # one at a time: a batch as Python strings would be several times its bytes
        group.append((column[k].as_py() or "").lower())
        size += len(group[-1])
        if size >= BLOCK_CHARS:
            yield first, group
            first, group, size = first + len(group), [], 0
    if group:
        yield first, group


def letters_of(texts: list[str]) -> list[str]:
    """The texts with every run of other characters as one space: numbers, addresses and marks say nothing of a language."""
    return [NOT_LETTERS.sub(" ", t).strip() for t in texts]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-gram counts of each language a task has seen, a row for every ``SLICE`` buckets."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for first, texts in text_groups(batch.column(1)):
            points, starts = code_points(texts)
            at = np.repeat(np.arange(len(texts)), np.diff(starts))
            langs = np.array(batch.column(0).slice(first, len(texts)).to_pylist(), dtype=object)
            for lang in set(langs):
                mine = (langs == lang)[at]
                count = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for rows in bucket_rows(points, starts):
                    count += np.bincount(rows[mine], minlength=BUCKETS + 1)[:BUCKETS]
    for lang, count in totals.items():
        slices = count.reshape(-1, SLICE)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(slices), pa.string()), pa.array(range(len(slices)), pa.int32()), pa.array([c.tobytes() for c in slices], pa.binary())], names=["lang", "slice", "counts"]
        )


def _floor_batches(broadcast):
    """One row for each language a task has seen: the lowest mean evidence of its texts with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lowest = broadcast.value, {}
        place = {lang: k for k, lang in enumerate(model.languages)}
        for batch in batches:
            for first, texts in text_groups(batch.column(1)):
                evidence, grams = model.evidence(letters_of(texts))
                for k, lang in enumerate(batch.column(0).slice(first, len(texts)).to_pylist()):
                    if any(map(str.isalpha, texts[k])):
                        lowest[lang] = min(lowest.get(lang, 0.0), float(evidence[k, place[lang]] / grams[k]))
        yield pa.RecordBatch.from_arrays([pa.array(list(lowest), pa.string()), pa.array(list(lowest.values()), pa.float64())], names=["lang", "lowest"])

    return run


def _sum_counts(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(c, np.int64) for c in rows["counts"]], axis=0)
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "slice": [rows["slice"].iloc[0]], "counts": [total.tobytes()]})


@dataclass
class LanguageModel:
    languages: list[str]
    log_probability: np.ndarray  # buckets x languages, then a row of zeros for the empty bucket
    floor: np.ndarray | None = None  # least mean log probability per n-gram of each language's texts

    @staticmethod
    def learned(labelled: DataFrame) -> DataFrame | None:
        """(lang, text): all rows of (text, lang) that have a lang; None without any."""
        labelled = labelled.select(F.col("lang").cast("string").alias("lang"), "text").filter("lang IS NOT NULL")
        languages = labelled.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
        if languages > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        return labelled if languages else None

    @classmethod
    def train(cls, labelled: DataFrame) -> LanguageModel:
        """``labelled``: text, lang; rows without lang are left out."""
        return cls.fit(cls.learned(labelled))

    @classmethod
    def fit(cls, learned: DataFrame | None) -> LanguageModel:
        if learned is None:
            return cls([], np.zeros((BUCKETS + 1, 0), np.float32))
        row = "lang string, slice int, counts binary"
        counted = learned.mapInArrow(_count_batches, row).groupBy("lang", "slice").applyInPandas(_sum_counts, row)
        found: dict[str, np.ndarray] = {}
        for r in counted.collect():  # BUCKETS counts a language
            found.setdefault(r["lang"], np.zeros(BUCKETS, np.int64))[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
        languages = sorted(found)
        counts = np.array([found[x] for x in languages], dtype=np.float64) + SMOOTHING
        matrix = np.log(counts / counts.sum(axis=1, keepdims=True)).T
        return cls(languages, np.vstack([matrix, np.zeros((1, len(languages)))]).astype(np.float32))

    def with_floor(self, learned: DataFrame) -> LanguageModel:
        """The model with each language's floor over all rows of ``learned`` (lang, text)."""
        if not self.languages:
            return self
        broadcast = learned.sparkSession.sparkContext.broadcast(self)
        found = learned.mapInArrow(_floor_batches(broadcast), "lang string, lowest double").groupBy("lang").agg(F.min("lowest").alias("lowest"))
        lowest = {r["lang"]: r["lowest"] for r in found.collect()}  # one row a language
        return LanguageModel(self.languages, self.log_probability, np.array([lowest.get(x, -np.inf) for x in self.languages]) - FLOOR_MARGIN)

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each text in each language, n-grams of each text) of lower-cased texts."""
        points, starts = code_points(texts)
        evidence = np.zeros((len(texts), len(self.languages)))
        for rows in bucket_rows(points, starts):
            evidence += np.add.reduceat(self.log_probability[rows], starts[:-1], axis=0, dtype=np.float64)
        return evidence, np.diff(starts) * len(ORDERS)

    def belongs(self, texts: list[str]) -> np.ndarray:
        """Whether each lower-cased text has a letter and reaches the floor of its best language."""
        lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        if not self.languages or self.floor is None:
            return lettered
        evidence, grams = self.evidence(letters_of(texts))
        best = evidence.argmax(axis=1)
        return lettered & (evidence[np.arange(len(texts)), best] / grams >= self.floor[best])

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, its posterior) of lower-cased texts."""
        evidence, grams = self.evidence(texts)
        evidence = (evidence - evidence.max(axis=1, keepdims=True)) / np.sqrt(grams)[:, None]
        weight = np.exp(evidence)
        return weight.argmax(axis=1), weight.max(axis=1) / weight.sum(axis=1)


def _predict_batches(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = broadcast.value
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for first, texts in text_groups(batch.column(text)):
                best, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
                if model.languages:
                    lettered = np.array([any(map(str.isalpha, t)) for t in texts])
                    guess, sure = model.predict(texts)
                    best, score = np.where(lettered, guess, best), np.where(lettered, sure, score)
                rest = batch.slice(first, len(texts))
                columns = [c for k, c in enumerate(rest.columns) if k != text]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())],
                    names=[*(f.name for k, f in enumerate(rest.schema) if k != text), "lang_pred", "score"],
                )

    return run


def identify(documents: DataFrame, model: LanguageModel, *keep: str) -> DataFrame:
    """``keep`` columns of every row, lang_pred and score."""
    spark = documents.sparkSession
    broadcast = spark.sparkContext.broadcast(model)
    chosen = documents.select(*keep, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text")
    return chosen.mapInArrow(_predict_batches(broadcast), f"{fields}, lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _keep_batches(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [k for _, texts in text_groups(batch.column(batch.schema.get_field_index("text"))) for k in broadcast.value.belongs(texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def drop_foreign(documents: DataFrame, labelled: DataFrame) -> DataFrame:
    """The documents, with all their columns, that belong to a language of ``labelled`` (text, lang)."""
    learned = LanguageModel.learned(labelled)
    model = LanguageModel.fit(learned)
    model = model if learned is None else model.with_floor(learned)
    broadcast = documents.sparkSession.sparkContext.broadcast(model)
    return documents.mapInArrow(_keep_batches(broadcast), documents.schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    documents = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("held_out", held_out())
    model = LanguageModel.train(documents.filter("NOT held_out"))
    return identify(documents, model, "doc_id", "held_out")
