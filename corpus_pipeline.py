"""Corpus pipeline: each stage works on what its predecessor kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of the documents.
"""

from __future__ import annotations

from lectern.llm import decontam, exact_dedup, language_id, mixing, near_dedup

#: Near copies: word shingles of five words, similarity of 0.8 or more.
NEAR = {"percent": 80, "n": 5, "permutations": 48}


def identify_language(spark, docs, sf_dir):
    """Rejects texts that belong to no learned language: without a letter, or far less likely than any labelled text."""
    return language_id.drop_foreign(docs, docs)


def drop_copies(spark, docs, sf_dir):
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark, docs, sf_dir):
    return near_dedup.drop_near_duplicates(docs, **NEAR)


def drop_contaminated(spark, docs, sf_dir):
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs, sf_dir):
    return mixing.mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Banded candidates and the naive Bayes model have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows that the stages leave of ``documents``, each stage's output written and read again."""
    from lectern.plans.scratch import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
