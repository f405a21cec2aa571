"""The phrase index counts what the alternation counts, and takes large lexicons."""

import random
import re
import time

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.lexicon import Lexicon
from lectern.operators import phrase_index as pi

TERMS = {
    "a": ["far left", "far-left wing", "other side of the aisle", "side of the aisle", "radical", "radical left", "don't know", "my good friend", "friend of mine", "gentleman yields"],
    "b": ["left wing", "wing nut", "left wing nut", "abuse of office", "office", "snake_case name", "the party", "party"],
}
PARTS = ["far", "left", "lefts", "-", "wing", "wings", " ", "\n\t", "other", "sides", "side", "of the aisle", "radical", "radicals", "don't", "don’t", "know", "knows", "my good", "friend", "friends", "of mine", "nut", "nuts", "é", "abused", "of", "office", "offices", "snake_case", "names", ".", "the", "party", "parties", "gentlemen", "yield", "yields"]


def test_hits_equal_the_alternation(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(PARTS) + rng.choice([" ", " ", " ", "  ", "", "-", "\n"]) for _ in range(rng.choice([0, 5, 40, 300])))) for i in range(250)] + [(900, None), (901, ""), (902, "FAR LEFT Far Left far  left")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    for inflect in (True, False):
        compiled = {k: Lexicon.compile(v, inflect) for k, v in TERMS.items()}
        index = pi.index_phrases(spark, pi.phrase_rows(TERMS, inflect), docs)
        got = pi.phrase_hits(pi.matches(docs, index), {k: x.words for k, x in compiled.items()}).collect()
        got = {(r["id"], r["lexicon"]): (r["hits"], r["inside"]) for r in got}
        low = F.lower(F.coalesce("text", F.lit("")))
        for name, lexicon in compiled.items():
            words = F.size(F.filter(tx.tokens(low), lambda t: t.isin(*sorted(lexicon.words)))).alias("w")  # noqa: B023
            for r in docs.select("doc_id", F.regexp_count(low, F.lit(lexicon.phrases)).alias("n"), tx.count_hits(lexicon, low, tx.tokens(low)).alias("all"), words).collect():
                hits, inside = got.get((r["doc_id"], name), (0, 0))
                assert (hits, hits + r["w"] - inside) == (r["n"], r["all"]), (name, r)


def test_a_hundred_thousand_phrases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = [r["w"] for r in docs.select(F.explode(pi.words_of(F.col("text"))).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(4_000).collect()]
    rng = random.Random(3)
    texts = [r["text"] for r in docs.filter("length(text) > 200").orderBy("doc_id").limit(60).collect()]
    real = set()
    for t in texts:
        low = re.findall(r"[a-z]+(?: [a-z]+){2}", t.lower())
        real.update(low[:5])
    terms = sorted(real) + [" ".join(rng.sample(words, 3)) for _ in range(100_000)]
    began = time.monotonic()
    index = pi.index_phrases(spark, pi.phrase_rows({"big": terms}, inflect=False), docs)
    hits = {r["id"]: r["hits"] for r in pi.phrase_hits(pi.matches(docs, index)).collect()}
    assert time.monotonic() - began < 120
    small = Lexicon.compile(sorted(real), False)
    found = {r["id"] for r in pi.matches(docs, pi.index_phrases(spark, pi.phrase_rows({"real": sorted(real)}, inflect=False), docs)).collect()}
    assert found == {r["doc_id"] for r in docs.filter(F.lower("text").rlike(small.phrases)).collect()} and found <= set(hits)
    plan = pi.matches(docs, index)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
