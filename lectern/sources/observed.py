"""Counts taken in the pass that writes: no second scan to know what was malformed, rejected or covered.

A staged run is written first and switched after; the counts that Spark observed on the way decide between the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lectern.schema import conform
from lectern.sources import staged


def coverage_counts() -> dict[str, Column]:
    """Turns and words in all, of procedural turns and of turns of the analysed parties."""
    words, procedural = F.coalesce("word_count", F.lit(0)), F.coalesce("is_procedural", F.lit(False))
    classes = {"total": F.lit(True), "procedural": procedural, "nonprocedural": ~procedural, "analysis_party": ~procedural & F.coalesce(F.col("party").isin("D", "R", "I"), F.lit(False))}
    return {f"{k}_{u}": v for k, c in classes.items() for u, v in (("turns", F.count_if(c)), ("words", F.coalesce(F.sum(F.when(c, words)), F.lit(0))))}


def observed(rows: DataFrame, counts: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``rows`` with counts that are known once an action has run over them."""
    seen = Observation()
    return rows.observe(seen, *[v.alias(k) for k, v in counts.items()]), seen


def publish_observed(rows: DataFrame, root: str, key: str = "congress", malformed: Column | None = None, rejected: Column | None = None, max_rejected: int = 0, run: str | None = None) -> dict[str, int]:
    """Publish the turns among ``rows`` that are neither ``malformed`` nor ``rejected``, unless too many are.

    One scan: counts of malformed and rejected rows are observed before the filter, coverage after it, while the run is
    staged. More than ``max_rejected`` bad rows, or no good one, leave it staged and unseen. Returns all counts.
    """
    bad = {"malformed": malformed, "rejected": rejected}
    marks = {k: F.lit(False) if c is None else F.coalesce(c, F.lit(False)) for k, c in bad.items()}
    read, inputs = observed(rows, {"rows": F.count(F.lit(1)), "malformed": F.count_if(marks["malformed"]), "rejected": F.count_if(marks["rejected"] & ~marks["malformed"])})
    good, outputs = observed(conform(read.filter(~marks["malformed"] & ~marks["rejected"])), coverage_counts())
    made = staged.stage(good, root, key, run)
    counts = inputs.get | outputs.get
    if counts["malformed"] + counts["rejected"] > max_rejected:
        raise ValueError(f"{counts['malformed'] + counts['rejected']} of {counts['rows']} inputs rejected (limit {max_rejected}); nothing was published")
    if not counts["total_turns"]:
        raise ValueError("no turns to publish")
    staged.switch(rows.sparkSession, made)
    return counts
