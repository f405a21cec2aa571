"""Work that is heavy per row is done once a row, and not where a cheap look shows that there is none."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import scoring as sc
from lectern.functions import text as tx
from lectern.operators.reports import rank_correlations

GATED = {
    "COOPERATION_EXCLUSIONS": sc.COOPERATION_EXCLUSIONS, "HOSTILITY_EXCLUSIONS": sc.HOSTILITY_EXCLUSIONS, "MISCONDUCT_EXCLUSIONS": sc.MISCONDUCT_EXCLUSIONS,
    "MILD_EXCLUSIONS": sc.MILD_EXCLUSIONS, **sc.OTHER_PARTY_PHRASES,
}


def test_correlated_columns_are_made_once_a_row(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def made(x):
        calls.add(1)
        return None if x == 7 else x * x

    rows = spark.range(20).select(made("id").alias("a"), (-F.col("id")).alias("b"))
    out = rank_correlations(rows, ["a", "b"]).collect()
    assert [(r["a"], r["b"], round(r["spearman"], 9)) for r in out] == [("a", "b", -1.0)]
    assert calls.value == 20


def test_exclusions_are_not_searched_where_none_can_match(spark, monkeypatch):
    for name in list(GATED)[:4]:
        monkeypatch.setattr(sc, name, "(")  # fails wherever it is searched
    scorer, low = sc.Scorer.sample(), F.col("low")
    tok = tx.tokens(low)
    counts = {
        "attack": scorer.attack(low, tok), "comity": scorer.comity(low, tok), "mild": scorer.profanity_counts(low, tok)["profanity_mild"], "misconduct": F.size(scorer.misconduct_spans(low, tok)),
    }
    frame = spark.createDataFrame([("shameful conduct, gentleman; bipartisan; bribery, abuse of office",)], "low string").select("low", *[v.alias(k) for k, v in counts.items()])
    assert frame.drop("low").first().asDict() == {"attack": 1, "comity": 2, "mild": 0, "misconduct": 2}
    for text, name in (("liar", "attack"), ("in a bipartisan board", "comity"), ("damn", "mild"), ("corrupt", "misconduct")):
        with pytest.raises(Exception, match="(?i)pattern|regex"):
            spark.createDataFrame([(text,)], "low string").select(dict(counts)[name].alias("n")).collect()


def test_every_match_of_a_gated_pattern_has_one_of_its_literals():
    needs = {"COOPERATION_EXCLUSIONS": sc.COOPERATION_NEEDS, "HOSTILITY_EXCLUSIONS": sc.HOSTILITY_NEEDS, "MISCONDUCT_EXCLUSIONS": sc.MISCONDUCT_NEEDS, "MILD_EXCLUSIONS": sc.MILD_NEEDS, **sc.OTHER_PARTY_NEEDS}
    rng = random.Random(6)
    for name, pattern in GATED.items():
        # Each alternative is made up anew many times: one choice of each group, optional parts or not, any white space.
        words = sorted(set(re.findall(r"[a-z]+", pattern.replace(r"\b", " ").replace(r"\s", " ").replace(r"\w", " "))))
        heads = [re.sub(r"\\b", "", x) for x in re.split(r"\|(?=\\b)", pattern)]
        seen = 0
        for _ in range(2_000):
            x = rng.choice(heads).replace(r"(?:\w+\s+){0,4}", "".join(rng.choice(words) + rng.choice([" ", "\n", "\t "]) for _ in range(rng.randrange(5))))
            while m := re.search(r"\(\?:([^()]*)\)(\??)", x):
                x = x[: m.start()] + ("" if m[2] and rng.random() < 0.5 else rng.choice(m[1].split("|"))) + x[m.end() :]
            x = re.sub(r"(\w)\?", lambda m: rng.choice([m[1], ""]), x.replace(r"\?", "\0"))
            x = re.sub(r"\\s\+", lambda _: rng.choice([" ", "\n", " \t"]), x).replace("\0", "?")
            if re.search(pattern, x):
                seen += 1
                assert any(n in x for n in needs[name]), (name, x)
        assert seen > 1_500, (name, seen)


def test_words_inside_many_phrases_are_counted_once(spark):
    lexicon = sc.Lexicon.compile(["in", "the", "in the", "the end"], inflect=False)
    low = "in the end-in the\nend, the in-the, in\tthe in the the end"
    found = [m[0] for m in re.finditer(lexicon.phrases, low)]
    count = lambda s: sum(t in lexicon.words for t in re.findall(r"[a-z0-9]+(?:[-'’][a-z0-9]+)*", s))
    frame = spark.createDataFrame([(low,), ("",)], "low string")
    got = [r[0] for r in frame.select(tx.count_hits(lexicon, F.col("low"), tx.tokens(F.col("low")))).collect()]
    assert got == [count(low) + len(found) - sum(map(count, found)), 0]
