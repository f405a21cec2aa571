"""Annotation passes: checks, agreement, adjudication, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Annotation fields and their vocabularies, and the score that predicts each field.
FIELDS = (
    "target_exists", "outparty_target_exists", "target_party", "formulaic_address", "procedural_deference", "gratitude_praise",
    "bipartisan_cooperation", "personal_attack", "misconduct_allegation", "ideological_label", "profanity", "identity_slur",
    "quoted_or_read_in", "ambiguous",
)
VOCABULARY = {f: ("yes", "no", "uncertain") for f in FIELDS} | {
    "target_party": ("d", "r", "i", "other", "none", "uncertain"),
    "ambiguous": ("yes", "no"),
    "confidence": ("low", "medium", "high"),
}
PREDICTED_BY = {
    "outparty_target_exists": "outgroup_refs", "formulaic_address": "formal_courtesy_hits", "gratitude_praise": "gratitude_praise_hits",
    "bipartisan_cooperation": "cooperation_hits", "personal_attack": "hostility_hits", "misconduct_allegation": "misconduct_hits",
    "ideological_label": "ideological_label_hits", "profanity": "profanity_hits", "identity_slur": "profanity_slurs",
}


def clean_labels(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f: F.lower(F.trim(F.col(f))) for f in VOCABULARY if f in rows.columns})


def vocabulary_violations(rows: DataFrame) -> DataFrame:
    """(sample_id, field, value) outside the vocabulary, blank rationales and blank ids."""
    bad = [F.when(~F.coalesce(F.col(f).isin(*VOCABULARY[f]), F.lit(False)), F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))) for f in VOCABULARY if f in rows.columns]
    for f in ("rationale", "sample_id"):
        if f in rows.columns:
            bad.append(F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) == "", F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))))
    return rows.select("sample_id", F.inline(F.filter(F.array(*bad), lambda b: b.isNotNull())))


def id_differences(a: DataFrame, b: DataFrame, keys=("sample_id",)) -> DataFrame:
    """Keys on one side only; empty if both sides have the same ids (and identity columns)."""
    only = lambda x, y, side: x.select(*keys).exceptAll(y.select(*keys)).withColumn("only_in", F.lit(side))
    return only(a, b, "a").unionByName(only(b, a, "b"))


def repeated_ids(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def one_a_key(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """``rows``; a blank or repeated key fails the job. The shuffle by key serves a join on it too."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    wrong = F.raise_error(F.concat(F.lit(f"blank or repeated {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    ok = (F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "") & (F.col("_n") == 1)
    return rows.withColumn("_n", n).filter(F.when(ok, True).otherwise(wrong)).drop("_n")


def require_same_ids(a: DataFrame, b: DataFrame, keys=("sample_id",)) -> None:
    """Raise unless both sides have the same ids (and identity columns)."""
    first = id_differences(a, b, keys).first()
    if first is not None:
        raise ValueError(f"only in {first['only_in']}: {[first[k] for k in keys]}")


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = one_a_key(a), one_a_key(b)
    other = b.select("sample_id", *[F.col(c).alias(f"{c}_b") for c in b.columns if c != "sample_id"])
    return a.select("sample_id", *[F.col(c).alias(f"{c}_a") for c in a.columns if c != "sample_id"]).join(other, "sample_id")


def agreement(a: DataFrame, b: DataFrame, fields=FIELDS) -> DataFrame:
    """(field, n, raw_agreement) over samples where both passes have a value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_a").alias("a"), F.col(f"{f}_b").alias("b")) for f in fields])
    long = _both(a, b).select(F.inline(pairs))
    comparable = (F.trim(F.coalesce("a", F.lit(""))) != "") & (F.trim(F.coalesce("b", F.lit(""))) != "")
    return long.groupBy("field").agg(F.count_if(comparable).alias("n"), F.avg(F.when(comparable, (F.col("a") == F.col("b")).cast("double"))).alias("raw_agreement"))


def _differ(f: str) -> Column:
    return F.coalesce(f"{f}_a", F.lit("")) != F.coalesce(f"{f}_b", F.lit(""))


def to_adjudicate(a: DataFrame, b: DataFrame, fields=FIELDS) -> DataFrame:
    some = F.lit(False)
    for f in fields:
        some = some | _differ(f)
    return _both(a, b).filter(some)


def final_labels(a: DataFrame, b: DataFrame, adjudicated: DataFrame, fields=FIELDS) -> DataFrame:
    """The common value, else the adjudicated one; confidence and rationale of whoever decided.

    Both passes must have the same ids, once each, and adjudications no others; anything else raises.
    """
    require_same_ids(a, b)
    if not adjudicated.join(a, "sample_id", "left_anti").isEmpty():
        raise ValueError("adjudications of samples that were not annotated")
    adjudicated = one_a_key(adjudicated)
    third = adjudicated.select("sample_id", *[F.col(c).alias(f"{c}_c") for c in (*fields, "confidence", "rationale")])
    joined = _both(a, b).join(third, "sample_id", "left")
    same = {f: (F.col(f"{f}_a") == F.col(f"{f}_b")) & F.col(f"{f}_a").isNotNull() for f in fields}
    settled = F.lit(True)
    for f in fields:
        settled = settled & F.coalesce(same[f], F.lit(False))
    out = [F.when(same[f], F.col(f"{f}_a")).otherwise(F.col(f"{f}_c")).alias(f) for f in fields]
    return joined.select("sample_id", *out, *[F.when(settled, F.col(f"{c}_a")).otherwise(F.col(f"{c}_c")).alias(c) for c in ("confidence", "rationale")])


def precision_recall(labels: DataFrame, scores: DataFrame, meta: DataFrame, predicted_by=PREDICTED_BY) -> DataFrame:
    """Per field, overall (era and source 'all') and by era and source family, in one pass of grouping sets."""
    labels, scores = one_a_key(labels), one_a_key(scores)
    joined = labels.join(scores, "sample_id").join(meta.select("sample_id", "era", "source_family"), "sample_id")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f)).alias("label"), (F.coalesce(F.col(s), F.lit(0)) > 0).alias("predicted")) for f, s in predicted_by.items()])
    long = joined.select("era", "source_family", F.inline(each)).withColumn("valid", F.coalesce(F.col("label").isin("yes", "no"), F.lit(False)))
    yes = F.col("label") == "yes"
    counts = [
        F.count_if("valid").alias("n_coded"), F.count_if(F.col("valid") & yes & F.col("predicted")).alias("tp"),
        F.count_if(F.col("valid") & ~yes & F.col("predicted")).alias("fp"), F.count_if(F.col("valid") & yes & ~F.col("predicted")).alias("fn"),
    ]
    sets = [[F.col("field")], [F.col("field"), F.col("era"), F.col("source_family")]]
    out = long.groupingSets(sets, "field", "era", "source_family").agg(F.grouping("era").alias("all_eras"), *counts)
    name = lambda c: F.when(F.col("all_eras") == 1, "all").otherwise(F.col(c)).alias(c)
    return out.select(
        "field", name("era"), name("source_family"), "n_coded", "tp", "fp", "fn",
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
    )
