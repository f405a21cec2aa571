"""Lexicons, spans and scores against a small pure-Python scorer and hand-made sentences."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import scoring as sc
from lectern.functions import text as tx
from lectern.functions.lexicon import TOKEN, Lexicon, compile_tiers, inflections

TERMS = {
    "courtesy": ["my good friend", "distinguished colleague"], "gratitude": ["thank my colleague"], "cooperation": ["bipartisan", "reach across the aisle"],
    "hostility": ["coward", "liar"], "misconduct": ["bribery", "corrupt"], "labels": ["radical"], "idioms": ["other side of the aisle"],
}
SCORER = sc.Scorer.compile(TERMS, ["damn\tmild", "crap\tmild", "hellish\tstrong"], ["slurword"])


def py_spans(lexicon, text):
    phrases = [m.span() for m in re.finditer(lexicon.phrases, text)] if lexicon.phrases else []
    words = [m.span() for m in re.finditer(TOKEN, text) if m[0] in lexicon.words]
    return sorted(phrases + [w for w in words if not any(p[0] <= w[0] and w[1] <= p[1] for p in phrases)])


def py_count(lexicon, text):
    tokens = Counter(re.findall(TOKEN, text))
    n = sum(tokens[w] for w in lexicon.words)
    for m in re.finditer(lexicon.phrases, text) if lexicon.phrases else ():
        n += 1 - sum(t in lexicon.words for t in re.findall(TOKEN, m[0]))
    return n


def py_merge(spans, touching=False):
    out = []
    for a, b in sorted(spans):
        if out and (a <= out[-1][1] if touching else a < out[-1][1]):
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def py_misconduct(text):
    blocked = [m.span() for m in re.finditer(sc.MISCONDUCT_EXCLUSIONS, text)]
    kept, chain = [], None
    for a, b in py_spans(SCORER.misconduct, text):
        if any(a < e and s < b for s, e in blocked):
            continue
        near = re.search(sc.NEGATION.replace(r"\z", r"\Z"), text[max(0, a - 80) : a])
        joined = chain is not None and re.fullmatch(r"\s*(?:,\s*)?(?:or|and)\s*", text[chain:a])
        if near or joined:
            chain = b
        else:
            kept.append((a, b))
            chain = None
    return kept


def py_refs(text, party):
    spans = [m.span() for m in re.finditer(SCORER.idioms.phrases, text)]
    spans += [m.span() for m in re.finditer(TOKEN, text) if m[0] in sc.OTHER_PARTY_WORDS.get(party, ())]
    if party in sc.OTHER_PARTY_PHRASES:
        spans += [m.span() for m in re.finditer(sc.OTHER_PARTY_PHRASES[party], text)]
    return py_merge(spans)


WORDS = ["the", "no", "not", "evidence", "of", "bribery", "corrupt", "and", "or", ",", ".", "republicans", "democrat", "party", "democratic party", "gop", "coward", "liar",
         "bipartisan", "my good friend", "friends", "other side of the aisle", "damn", "radical", "without any", "un-american", "édamn", "x" * 90, "\n", "thank my colleagues", "colleague"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(WORDS), max_size=40), st.sampled_from(["D", "R", "I", "other"])), min_size=10, max_size=30))
def test_scores_equal_a_plain_scorer(spark, cases):
    rows = [(i, " ".join(w), p) for i, (w, p) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "i int, text string, party string")
    got = {r["i"]: r for r in sc.score_turns(frame, SCORER).collect()}
    for i, text, party in rows:
        low, r = text.lower(), got[i]
        refs = py_refs(low, party)
        assert r["n_words"] == len(re.findall(TOKEN, low))
        assert r["formal_courtesy_hits"] == py_count(SCORER.courtesy, low)
        assert r["hostility_hits"] == max(0, py_count(SCORER.hostility, low) - len(re.findall(sc.HOSTILITY_EXCLUSIONS, low)))
        assert r["misconduct_hits"] == len(py_misconduct(low))
        assert r["outgroup_refs"] == len(refs)
        windows = py_merge([(max(0, a - 200), min(len(low), b + 200)) for a, b in refs], touching=True)
        window = " \x1e ".join(low[a:b] for a, b in windows)
        assert r["directed_misconduct_hits"] == len(py_misconduct(window))
        contexts = 0
        for a, b in refs:
            left, right = re.search(r"[^.!?;\n]*\Z", low[max(0, a - 300) : a])[0], re.match(r"[^.!?;\n]*[.!?;\n]?", low[b : b + 300])[0]
            contexts += len(py_misconduct(left + low[a:b] + right)) > 0
        assert r["outgroup_misconduct_contexts"] == contexts


def one(spark, column, text, **more):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_offsets_are_code_points(spark):
    spans = one(spark, tx.match_spans(F.col("text"), "ab"), "é𝒳ab ab")
    assert [(s["st"], s["en"]) for s in spans] == [(2, 4), (5, 7)]


@pytest.mark.parametrize(("touching", "expected"), [(False, [(0, 3), (3, 5), (6, 9)]), (True, [(0, 5), (6, 9)])])
def test_merge_of_touching_spans(spark, touching, expected):
    spans = F.expr("array(named_struct('st', 3, 'en', 5), named_struct('st', 0, 'en', 3), named_struct('st', 6, 'en', 8), named_struct('st', 7, 'en', 9))")
    got = one(spark, tx.merge_spans(spans, touching), "x")
    assert [(s["st"], s["en"]) for s in got] == expected


def test_quotes_are_masked_at_equal_length(spark):
    spoken, quoted = tx.mask_quotes(F.col("text"))
    text = "a ``damn\nb'' c ``d'' ``open"
    assert one(spark, spoken, text) == "a " + " " * 10 + " c " + " " * 5 + " ``open"
    assert one(spark, quoted, text) == "damn\nb d"


def test_inflection_and_order():
    assert inflections("church") == {"church", "churches", "churched", "churching"}
    assert "ladies" in inflections("lady") and "days" in inflections("day") and "daies" not in inflections("day")
    assert Lexicon.compile(["reach across the aisle"]).phrases == Lexicon.compile(["reach across the aisle"] * 2).phrases
    assert Lexicon.compile(["len"]).words == {"len"}


def test_tiers():
    tiers = compile_tiers(["x\tmild", "x\tstrong", "y\tstrong"], ["y"])
    assert (tiers["mild"].words, tiers["strong"].words, tiers["slurs"].words) == (frozenset(), {"x"}, {"y"})
    with pytest.raises(ValueError, match="mild"):
        compile_tiers(["x\tother"])


def test_null_text_scores_as_empty(spark):
    row = sc.score_turns(spark.createDataFrame([(None, None)], "text string, party string"), SCORER).first()
    assert row["n_words"] == 0 and sum(row[s] for s in sc.SCORES) == 0
