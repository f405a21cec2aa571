"""Span algebra: brute force on random texts and spans, and time in proportion to the number of spans."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import scoring
from lectern.functions import text as tx
from lectern.functions.lexicon import Lexicon

LEXICON = Lexicon.compile(["corrupt", "bribery", "abuse of office", "office"], False)
PARTS = ["not", "corrupt", "and", "or", "bribery", ",", "no evidence of", "x", "𝒳y", "abuse of office", "abuse", "office", ".", "without", "é", "corrupt practices"]
EXCLUDED = "not corrupt|corrupt practices|of office"


def py_merge(spans, touching):
    out = []
    for a, b in sorted(spans):
        if out and (a <= out[-1][1] if touching else a < out[-1][1]):
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def py_unnegated(spans, text):
    until, out = -1, []
    for a, b in spans:
        ends, joins = (p.replace(r"\z", r"\Z") for p in (scoring.NEGATION, scoring.COORDINATION))
        if re.search(ends, text[max(0, a - 80) : a]) or (until >= 0 and re.search(joins, text[until:a])):
            until = b
        else:
            until = -1
            out.append((a, b))
    return out


def py_spans(text):
    phrases = [m.span() for m in re.finditer(LEXICON.phrases, text, re.A)]
    words = [m.span() for m in re.finditer(tx.token_pattern(LEXICON.words), text)]
    return sorted(phrases + [w for w in words if not any(a <= w[0] and w[1] <= b for a, b in phrases)])


def test_spans_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [
        (" ".join(rng.choice(PARTS) for _ in range(rng.choice([0, 3, 20, 200, 700]))), [tuple(sorted((rng.randint(0, 300), rng.randint(0, 300)))) for _ in range(rng.randint(0, 60))])
        for _ in range(200)
    ]
    t, spans = F.col("t"), tx.lexicon_spans(LEXICON, F.col("t"))
    made = spark.createDataFrame(rows, f"t string, s {tx.SPANS}").select(
        "*", tx.merge_spans(F.col("s")).alias("apart"), tx.merge_spans(F.col("s"), touching=True).alias("touching"), spans.alias("found"),
        tx.without_overlaps(spans, t, EXCLUDED).alias("clear"), tx.unnegated(spans, t, scoring.NEGATION, scoring.COORDINATION).alias("plain"),
        tx.window_text(t, spans, 20).alias("window"), tx.span_contexts(t, spans, 30).alias("contexts"),
    )
    for r in made.collect():
        text, found = r["t"], py_spans(r["t"])
        pairs = lambda c: [tuple(x) for x in r[c]]  # noqa: B023, E731
        assert pairs("apart") == py_merge(r["s"], False) and pairs("touching") == py_merge(r["s"], True)
        assert pairs("found") == found and pairs("plain") == py_unnegated(found, text)
        blocked = [m.span() for m in re.finditer(EXCLUDED, text)]
        assert pairs("clear") == [s for s in found if not any(s[0] < b and a < s[1] for a, b in blocked)]
        around = py_merge([(max(0, a - 20), min(len(text), b + 20)) for a, b in found], True)
        assert r["window"] == " \x1e ".join(text[a:b] for a, b in around)
        assert r["contexts"] == [re.search(r"[^.!?;\n]*\Z", text[max(0, a - 30) : a])[0] + text[a:b] + re.match(r"[^.!?;\n]*[.!?;\n]?", text[b : b + 30])[0] for a, b in found]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 9, 1000])
def test_scans(spark, n):
    values = [(k * 7919) % 101 - 50 for k in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(tx.running_sum(F.col("v")).alias("s"), tx.running_max(F.col("v")).alias("m")).first()
    assert row["s"] == [sum(values[: i + 1]) for i in range(n)] and row["m"] == [max(values[: i + 1]) for i in range(n)]


def test_pieces_from_blocks(spark):
    text = "".join(chr(97 + k % 26) if k % 5 else "𝒳" for k in range(3 * tx.BLOCK + 77))
    cuts = [(0, 5), (tx.BLOCK - 1, 2), (tx.BLOCK, 1), (3, 2 * tx.BLOCK), (len(text) - 3, 100), (10, 0), (2 * tx.BLOCK - 4, 300)]
    row = spark.createDataFrame([(text, cuts)], "t string, c array<struct<st:int,n:int>>").select(tx.in_blocks(F.col("t"), lambda b: F.transform("c", lambda x: b.piece(x["st"], x["n"])))).first()
    assert row[0] == [text[a : a + n] for a, n in cuts]


def test_a_hundred_thousand_matches_in_one_text(spark):
    text = " ".join(["corrupt", "and bribery", "abuse of office", "not corrupt"][k % 4] for k in range(100_000))
    frame = spark.createDataFrame([(text,)], "t string").cache()
    t = F.col("t")
    spans = tx.lexicon_spans(LEXICON, t)
    steps = {"found": spans, "clear": tx.without_overlaps(spans, t, "not corrupt|bribery abuse"), "merged": tx.merge_spans(spans), "plain": tx.unnegated(spans, t, scoring.NEGATION, scoring.COORDINATION)}
    for name, step in steps.items():
        frame.select(F.size(step)).collect()  # compiled by then
        began = time.monotonic()
        n = frame.select(F.size(step)).first()[0]
        assert n == {"found": 100_000, "clear": 25_000, "merged": 100_000, "plain": 75_000}[name]
        assert time.monotonic() - began < 8, name  # about 2 s on a free machine; the folds took minutes
