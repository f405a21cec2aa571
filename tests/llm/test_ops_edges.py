"""Every operator with nulls in any column, empty tables, repeated rows and extra columns with clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import decontam, exact_dedup, html_extract, language_id, mixing, near_dedup, pii, quality, substring_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, term string, kept int, pos int, score double, node long, n int, t string, mix_key string"
PASSAGE = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"w{i % 700}" for i in range(30_000))
TEXTS = [
    None, "", "   \t\n", "1 2 3 !!", "Short one", f"{PASSAGE} tail one two", f"Head here {PASSAGE}", f"{PASSAGE} tail one two", f"{PASSAGE}  TAIL one\ttwo", LONG, "a a a a " * 30,
    "mail me at joe@mail.example.com or +1 (555) 555-1234", "Ünïcödé ẞ 𝒳 Über", "x",
]


def docs(spark, rows=None):
    made = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", None, i, "the", 1, 2, 0.5, 7, 3, "t", "old") for i, t in enumerate(TEXTS)]
    made += [(None, "no id at all here", None, None, None, *[None] * 9), (4, "Short one", "en", "s1", None, *[None] * 9), (5, "same id other text", "en", "s1", None, *[None] * 9)]
    return spark.createDataFrame(made if rows is None else rows, SCHEMA)


@pytest.fixture(scope="module")
def full(spark):
    return docs(spark).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE, "x"), (2, None, "x"), (3, "short one", "x"), (None, "never seen words", "x"), (1, PASSAGE, "x")], "item_id long, text string, phrase string")


def test_decontamination(spark, full, bench):
    found = decontam.contamination(decontam.build_index(full, bench)).collect()
    assert len(found) == len(TEXTS) + 3
    by = {(r["doc_id"], r["n_words"]): r for r in found}
    assert by[5, 63]["n_hit"] == 60 and by[5, 63]["item_ids"] == ["1"]
    assert by[4, 2]["n_hit"] == 2 and by[0, 0]["n_hit"] == 0
    kept = decontam.decontaminate(full, bench)
    assert kept.columns == full.columns and kept.filter("doc_id = 4").count() == 0 and kept.filter("doc_id = 5").count() == 1
    assert decontam.contamination(decontam.build_index(docs(spark, []), bench)).count() == 0
    assert decontam.contamination(decontam.build_index(full, bench.limit(0))).filter("n_hit > 0").count() == 0


def test_phrase_and_proximity(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta x gamma delta"), (3, "delta gamma beta alpha")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    index = decontam.build_index(d, b, n=4)
    rows = lambda m: sorted({r["doc_id"] for r in m.join(index.postings.select("row", "doc_id").distinct(), "row").collect()})
    assert rows(decontam.phrase_matches(index)) == [1]
    assert 2 in rows(decontam.proximity_matches(index, 1)) and 1 in rows(decontam.proximity_matches(index, 0))


def test_exact_dedup(spark, full):
    found = exact_dedup.duplicates(full).collect()
    assert len(found) == len(TEXTS) + 3
    groups = {}
    for r in found:
        groups.setdefault(r["text_sha256"], []).append(r)
    for g in groups.values():
        assert sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)}
    by = {(r["doc_id"], r["text_sha256"]): r for r in found}
    assert by[7, hashlib.sha256(TEXTS[7].encode()).hexdigest()]["keep_id"] == 5
    left = exact_dedup.drop_duplicates(full)
    assert left.columns == full.columns and left.count() == len(groups)
    assert exact_dedup.duplicates(docs(spark, [])).count() == 0 and exact_dedup.drop_duplicates(docs(spark, [])).count() == 0


def test_near_dedup(spark, full):
    found = near_dedup.components(full).collect()
    assert len(found) == len(TEXTS) + 3
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[7] == {5} and by[8] == {5} and by[0] == {0} and by[1] == {1} and by[2] == {2}
    left = near_dedup.drop_near_duplicates(full)
    assert left.columns == full.columns and left.filter("doc_id = 7").count() == 0 and left.filter("doc_id IS NULL").count() == 1
    assert near_dedup.components(docs(spark, [])).count() == 0


def test_substring_dedup(spark, full):
    done = substring_dedup.remove_repeats(full).collect()
    assert len(done) == len(TEXTS) + 3
    by = {(r["doc_id"], r["n_words"]): r for r in done}
    assert by[6, 62]["kept"] == "Head here" and by[0, 0]["kept"] == ""
    assert by[10, 120]["n_removed"] == 120  # repeats within one document
    assert by[9, 30_000]["n_removed"] == 30_000
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_language_id(spark, full):
    model = language_id.LanguageModel.train(full)
    out = language_id.identify(full, model, "doc_id", "row")
    assert out.columns == ["doc_id", "row", "lang_pred", "score"] and out.count() == len(TEXTS) + 3
    assert {r["doc_id"] for r in out.filter("lang_pred = 'und'").collect()} == {0, 1, 2, 3}
    kept = language_id.drop_foreign(full, full)
    assert kept.columns == full.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({0, 1, 2, 3})
    unlabelled = full.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.drop_foreign(full, unlabelled).count() == len(TEXTS) + 3 - 4  # what has a letter stays
    none = language_id.LanguageModel.train(docs(spark, []))
    assert {r["lang_pred"] for r in language_id.identify(full, none, "doc_id").collect()} == {"und"}


def test_quality(spark, full):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (9, 0, 1), (None, 1, 0), (7, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    w = quality.fit(quality.labelled_texts(full, labels))
    out = quality.score(full, w, "doc_id", "n").collect()
    assert len(out) == len(TEXTS) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    zero = quality.fit(quality.labelled_texts(full, labels.limit(0)))
    assert {r["score"] for r in quality.score(full, zero, "doc_id").collect()} == {0.5}


def test_mixing(spark, full):
    out = mixing.mix(full)
    assert set(out.columns) == {*full.columns, "mix_replica", "mix_key"}
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(full.repartition(3)).collect()))
    assert mixing.mix(full, {"s1": 1.0}).filter("source IS NULL OR source <> 's1'").count() == 0
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixing_hits_target_shares(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"), F.when(F.col("id") < 4500, "big").otherwise("small").alias("source"))
    n = {r["source"]: r["count"] for r in mixing.mix(d, {"big": 1.0, "small": 1.0}).groupBy("source").count().collect()}
    assert abs(n["big"] - 3000) < 250 and abs(n["small"] - 3000) < 250


def test_html(spark):
    model = html_extract.train(html_extract.example_frame(spark, 300))
    rows = [(1, None), (None, ""), (1, "<p>plain"), (2, "<html><body><nav><ul><li><a href=x>A</a></ul></nav><article><h1>T</h1><p>Body &amp; text of some length, really.<p>Two  parts\nhere &lt;b&gt;.</article><footer>&copy; x</footer>"), (3, "<" * 50 + "a" * 50)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, html string, text string")
    out = html_extract.extract(pages.withColumn("url", F.lit("u")), model, "page_id", "url").collect()
    assert len(out) == 5
    assert next(r["text"] for r in out if r["page_id"] == 2) == "T\nBody & text of some length, really.\nTwo parts here <b>."
    assert next(r["text"] for r in out if r["page_id"] is None) == ""
    assert html_extract.extract(pages.limit(0), model, "page_id").count() == 0


def test_url_filter(spark):
    rows = [(1, None), (None, "nonsense"), (2, "http://WWW.Example.COM/en/7x?q#f"), (3, "https://a.com"), (3, "https://a.com"), (4, "x://b.org/es/?a=1"), (5, "http://c.net?x"), (6, "http://.com/en/")]
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, host string, token int")
    out = url_filter.judge(pages, url_filter.rule_frame(spark)).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out if r["page_id"]}
    assert (by[2]["host"], by[2]["path"], by[2]["rule"], by[2]["verdict"]) == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert by[4]["verdict"] == "block" and by[5]["path"] == "" and by[1]["host"] == ""
    assert url_filter.judge(pages.limit(0), url_filter.rule_frame(spark)).count() == 0


def test_pii(spark, full):
    found = pii.personal_data(full).collect()
    assert len(found) == len(TEXTS) + 3
    row = next(r for r in found if r["doc_id"] == 11)
    assert [(s["start"], s["k"], s["end"]) for s in sorted(row["base"])] == [(11, 1, 31), (35, 4, 52)]
    assert pii.personal_data(docs(spark, [])).count() == 0


def test_pipeline_stages(spark, full, sf):
    out, left = full.drop("mix_key"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == full.drop("mix_key").columns
        left.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["text"])) for r in out.select("doc_id", "text").collect()))
    lettered = [(i, t) for i, t in [*enumerate(TEXTS), (None, "no id at all here"), (4, "Short one"), (5, "same id other text")] if t and any(map(str.isalpha, t))]
    assert len(left[0]) == len(lettered)
    assert len(left[1]) == len({" ".join(t.split()) for _, t in lettered})  # one row of equal texts
    assert len(left[2]) < len(left[1]) and (True, 0, 17) in left[2]  # the near copy goes, the row without an id stays
    assert left[3] == left[2]  # no benchmark passage
    assert corpus_pipeline.STAGES[-1][1](spark, out, sf).columns == [*out.columns, "mix_replica", "mix_key"]
