"""Compound sentiment: a plain loop as brute force, the rules one by one, and weighted means."""

import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from lectern.functions import sentiment as st
from lectern.functions.scoring import Scorer, score_turns
from lectern.operators import metrics

V = st.Valences({"good": 1.9, "great": 3.1, "bad": -2.5, "horrible": -2.5, "hope": 1.9, ":)": 2.0}, {"very": 1, "extremely": 1, "slightly": -1})


def py_sentence(s):
    words = []
    for t in s.split():
        bare = t.strip(string.punctuation)
        words.append(bare if len(bare) > 2 else t)
    loud = [w.upper() == w and w.lower() != w for w in words]
    mixed = 0 < sum(loud) < len(words)
    low = [w.lower() for w in words]
    but = low.index("but") if "but" in low else None
    values = []
    for i, w in enumerate(low):
        if w not in V.words:
            values.append(0.0)
            continue
        v = V.words[w]
        if loud[i] and mixed:
            v += 0.733 if v > 0 else -0.733
        for k, near in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i >= k and low[i - k] not in V.words:
                if low[i - k] in V.degrees:
                    push = 0.293 * V.degrees[low[i - k]] + (0.733 if loud[i - k] and mixed else 0)
                    v += near * (push if v > 0 else -push)
                if low[i - k] in V.negators or low[i - k].endswith("n't"):
                    v *= -0.74
        if but is not None and i != but:
            v *= 0.5 if i < but else 1.5
        values.append(v)
    total = sum(values)
    q = s.count("?")
    push = min(s.count("!"), 4) * 0.292 + (0 if q <= 1 else 0.18 * q if q <= 3 else 0.96)
    total += push if total > 0 else -push if total < 0 else 0
    up, down, neutral = sum(v + 1 for v in values if v > 0), sum(1 - v for v in values if v < 0), values.count(0.0)
    if up > down:
        up += push
    elif down > up:
        down += push
    return total / math.sqrt(total * total + 15), down / (up + down + neutral) if values else 0.0


def py_sentiment(text):
    each = [py_sentence(s) for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]
    return (sum(x for x, _ in each) / len(each), sum(y for _, y in each) / len(each), len(each)) if each else (0.0, 0.0, 0)


PARTS = ["good", "GREAT", "bad", "Horrible", "hope,", ":)", "very", "EXTREMELY", "slightly", "not", "never", "isn't", "but", "BUT", "the", "plan", "!", "!!", "??", "?", ".", "...", "(good)", "“great”", "a", "OK", "\n", "it's"]


def test_equals_a_plain_loop(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 4, 12, 60]))) for _ in range(400)] + [None, "", "  \n ", "!!!", "good" * 3, "GOOD BAD", "good!!!!!!!! bad????"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", st.compound_sentiment(V)(F.col("t")).alias("s"))
    for r in frame.collect():
        want = py_sentiment(texts[r["i"]])
        assert tuple(r["s"]) == pytest.approx(want, abs=1e-12), texts[r["i"]]


def test_each_rule_moves_the_score(spark):
    order = ["it is horrible", "it is not very good", "it is bad", "it is not good", "it is", "it is slightly good", "it is good", "it is good!", "it is very good", "it is GOOD", "it is VERY good"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(order)], "i int, t string").select("i", st.compound_sentiment(V)(F.col("t"))["sentiment"].alias("s"))
    got = dict(sorted((r["i"], r["s"]) for r in frame.collect()))
    assert got[4] == 0 and got[3] < 0 < got[5] < got[6] < got[7] and got[6] < got[8] < got[10] and got[6] < got[9] and got[1] < got[3] and got[0] == got[2]
    contrast = spark.createDataFrame([("good but bad",), ("bad but good",)], "t string").select(st.compound_sentiment(V)(F.col("t"))["sentiment"].alias("s")).collect()
    assert contrast[0]["s"] < 0 < contrast[1]["s"]


def test_means_weigh_sentences(spark):
    rows = [("s", 115, "house", "D", "Good. Great. Plain."), ("s", 115, "house", "D", "Bad."), ("s", 115, "house", "R", None)]
    turns = spark.createDataFrame(rows, "source string, congress int, chamber string, party string, text string")
    scored = score_turns(turns, Scorer.sample(), sentiment=st.compound_sentiment(V))
    table = {r["party"]: r for r in metrics.metric_table(metrics.sum_scores(scored, sentiment=True)).collect()}
    each = [py_sentence(s) for s in ("Good.", "Great.", "Plain.", "Bad.")]
    assert table["D"]["mean_sentiment"] == pytest.approx(sum(x for x, _ in each) / 4) and table["D"]["mean_neg_share"] == pytest.approx(sum(y for _, y in each) / 4)
    assert table["R"]["mean_sentiment"] is None
