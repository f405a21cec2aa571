"""Long inputs, ingest order, stored state, guards and checks on small fixtures."""

import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lectern.functions import scoring as sc
from lectern.functions import text as tx
from lectern.functions.lexicon import inflections
from lectern.operators import agreement as agr
from lectern.operators import bills as bl
from lectern.operators import coverage as cov
from lectern.operators import dedup as dd
from lectern.operators import incremental as inc
from lectern.operators import metrics as met
from lectern.operators import reports as rep
from lectern.operators import segments as seg
from lectern.operators import series as ser
from lectern.sources import bill_status, delimited, packages, sinks, turn_files
from test_operators import MEMBERS, SCORER, XML, frame, turn

N = 100_000


@pytest.mark.parametrize(
    ("text", "words"), [("a-" * N + "a", 1), ("- " * N, 0), ("a " * N, N), ("'" * N, 0), ("a--" * N, N), (" " * N + "x", 1), ("\n" * N + "x", 1), ("not " * N + "se", N + 1)],
)
def test_long_runs_are_tokenised_scored_and_stripped(spark, text, words):
    one = spark.createDataFrame([(text, "D")], "text string, party string")
    row = sc.score_turns(one, SCORER).select("n_words", seg.without_header(F.col("text")).alias("t")).first()
    assert row["n_words"] == words and row["t"] == text.strip()


def test_long_transcripts_are_segmented(spark):
    text = "\n" * N + "[House]\n" * 3 + "Mr. SMITH of Texas. " + "word " * N + " " * N + "\nMs. JONES. Thanks." + "\t" * N
    g = spark.createDataFrame([("G", "2017-01-03", 115, "house", text, MEMBERS)], "granule_id string, date string, congress int, chamber string, text string, members array<struct<party:string,bioguide:string,name:string,state:string>>")
    got = seg.turns_of(g).select("turn_id", "word_count", F.length("text").alias("n")).orderBy("turn_id").collect()
    assert [tuple(r) for r in got] == [("crec:G#0", N, 5 * N - 1), ("crec:G#1", 1, 7)]


def test_regular_forms():
    examples = {
        "buzz": {"buzz", "buzzes", "buzzed", "buzzing"}, "bake": {"bake", "bakes", "baked", "baking"}, "carry": {"carry", "carrys", "carries", "carryed", "carrying"},
        "play": {"play", "plays", "played", "playing"}, "woman": {"woman", "womans", "women", "womaned", "womaning"}, "push": {"push", "pushes", "pushed", "pushing"},
    }
    for word, forms in examples.items():
        assert inflections(word) == forms


def test_polarity_sentiment_by_hand(spark):
    sentiment = sc.polarity_sentiment({"good": 2.0, "bad": -3.0})
    row = spark.createDataFrame([("Good thing. Not good! A bad day?",), (None,), ("none here",)], "text string").select(sentiment(F.col("text")).alias("s")).select("s.*").collect()
    value = lambda x: x / (x * x + 15) ** 0.5
    assert row[0]["sentiment"] == pytest.approx((value(2) + value(-2) + value(-3)) / 3) and row[0]["neg_share"] == pytest.approx(2 / 3) and row[0]["n_sentences"] == 3
    assert tuple(row[1]) == (0.0, 0.0, 0) and tuple(row[2]) == (0.0, 0.0, 1)


def test_metric_table_has_sentence_weighted_sentiment(spark):
    t = frame(spark, [turn(1, text="good. good. good."), turn(2, text="bad."), turn(3, text="", party="R")])
    sums = met.sum_scores(sc.score_turns(met.with_groups(t), SCORER, sentiment=sc.polarity_sentiment({"good": 1.0, "bad": -1.0})), sentiment=True)
    got = {r["party"]: r for r in met.metric_table(met.merge_sums(sums)).collect()}
    assert got["D"]["mean_sentiment"] == pytest.approx(0.5 * 1 / 16**0.5) and got["D"]["mean_neg_share"] == pytest.approx(0.25)
    assert got["R"]["mean_sentiment"] is None


def test_quoted_profanity_only_scores_profanity(spark):
    from lectern.operators import members as mem

    rows = [turn(1, text="``damn, to damn them all'' damn"), turn(2, text="none")]
    got = {r["turn_id"]: (r["profanity_hits"], r["profanity_quoted_hits"]) for r in mem.score_spoken(frame(spark, rows), SCORER).collect()}
    assert got == {"t1": (1, 1), "t2": (0, 0)}


def test_without_repeats_equals_first_wins(spark):
    rows = spark.createDataFrame([(f"t{i % 7}", f"f{i % 3}", i, i % 2 == 0, "x") for i in range(40)], "turn_id string, file string, pos long, s boolean, text string")
    a = dd.without_repeats(rows, "turn_id", ["file", "pos"], scope=F.col("s")).collect()
    b = dd.first_wins(rows, F.col("file"), F.col("pos"), scope=F.col("s")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


PART = """<relatedItem type="constituent" ID="id-{gid}"><extension><granuleClass>{kind}</granuleClass><chamber>{chamber}</chamber>
<congMember bioGuideId="V1" party="D" state="MD"><name type="authority-fnf">Chris Van Hollen</name></congMember></extension></relatedItem>"""


def package(path, parts, name="CREC-2017-01-03.zip"):
    mods = "<mods xmlns='http://x'><extension><congress>115</congress></extension>" + "".join(PART.format(gid=g, kind=k, chamber=c) for g, k, c, _ in parts) + "</mods>"
    with zipfile.ZipFile(path / name, "w") as z:
        z.writestr("p/mods.xml", mods)
        for gid, _, _, text in parts:
            z.writestr(f"p/{gid}.htm", f"<html><body><pre>{text}</pre></body></html>")


def test_package_classes_order_and_fingerprints(spark, tmp_path):
    long = "Words of the day. " * 40
    turns = "".join(f"\n  Mr. VAN HOLLEN. Short number {i}.\n" for i in range(11))
    package(tmp_path, [
        ("B2", "EXTENSIONS", "HOUSE", "Remarks of the day."), ("A1", "DAILYDIGEST", "", "Digest of the day."), ("odd-id", "HOUSE", "", f"{turns}  Mr. VAN HOLLEN. {long}\n"),
        ("a0", "HOUSE", "", f"  Mr. VAN HOLLEN. {long}\n  The SPEAKER. {long}"), ("none", "HOUSE", "", ""),
    ])
    granules = packages.read_packages(spark, str(tmp_path))
    got = {r["turn_id"]: r for r in packages.package_turns(granules).collect()}
    assert got["crec:B2#0"]["chamber"] == "extensions" and got["crec:A1#0"]["chamber"] == "other"
    assert "crec:odd-id#11" in got and "crec:a0#0" not in got  # the first in the package stays, by document order
    assert got["crec:a0#1"]["is_procedural"]  # another speaker, so another turn
    assert len(packages.package_turns(granules, ("HOUSE",)).filter("chamber <> 'house'").collect()) == 0


def test_package_without_congress_is_left_out(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "CREC-x.zip", "w") as z:
        z.writestr("mods.xml", "<mods>" + PART.format(gid="g", kind="HOUSE", chamber="") + "</mods>")
        z.writestr("g.htm", "<pre>text</pre>")
    assert packages.package_turns(packages.read_packages(spark, str(tmp_path))).count() == 0


def test_publishing_packages_is_all_or_nothing(spark, tmp_path):
    out, log = str(tmp_path / "turns"), str(tmp_path / "runs")
    t = frame(spark, [turn(1), turn(2, congress=116)]).withColumn("package", F.lit("CREC-2017-01-03"))
    asked = lambda *names: spark.createDataFrame([(n,) for n in names], "package string")
    with pytest.raises(ValueError, match="1 packages failed"):
        turn_files.publish_packages(t, asked("CREC-2017-01-03", "CREC-2017-01-04"), out, log)
    assert turn_files.load_partitions(spark, out) is None
    run = turn_files.publish_packages(t, asked("CREC-2017-01-03"), out, log)
    assert run["new_turns"] == 2 and [o["congress"] for o in run["outputs"]] == [115, 116] and spark.read.parquet(out).count() == 2
    assert turn_files.publish_packages(t, asked("CREC-2017-01-03"), out, log)["new_turns"] == 0
    assert [r["published"] for r in spark.read.json(log).orderBy("at").collect()] == [False, True, True]


def test_unreadable_archives_have_no_congresses(spark, tmp_path):
    (tmp_path / "broken.zip").write_bytes(b"PK half a download")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("hein-daily/speeches_101.txt", "speech_id|speech\n1|x\n")
    (tmp_path / "speeches_099.txt").write_text("speech_id|speech\n")
    assert delimited.available_congresses(spark, str(tmp_path)) == [99, 101]
    assert delimited.read_zipped_lines(spark, str(tmp_path), "speeches_", "speech_id|").count() == 1


def archive(path, *names, text=XML.format(t="type", n="number")):
    with zipfile.ZipFile(path / "b.zip", "w") as z:
        for name in names:
            z.writestr(name, text)


def test_bill_archives_are_checked(spark, tmp_path):
    archive(tmp_path, "BILLSTATUS-118hr5.xml", "other.xml")
    row = bill_status.checked_bills(bill_status.read_archives(spark, str(tmp_path))).collect()
    assert [r["bill_id"] for r in row] == ["118-hr-5"] and row[0]["source_updated_at"].endswith(":00")
    archive(tmp_path, "BILLSTATUS-118hr6.xml")
    with pytest.raises(PySparkException, match="118-hr-6"):
        bill_status.checked_bills(bill_status.read_archives(spark, str(tmp_path))).collect()
    archive(tmp_path, "x/BILLSTATUS-118hr5.xml", "y/BILLSTATUS-118hr5.xml")
    with pytest.raises(PySparkException, match="twice"):
        bill_status.read_archives(spark, str(tmp_path)).collect()


BILLS = "bill_id string, congress string, bill_type string, bill_number string, origin_chamber string, passed_any_chamber boolean, became_law boolean, v int"


def test_bills_are_normalised(spark):
    rows = [("118-s-2", "118", "s", "2", " S ", None, None, 1), ("118-hr-10", "118", "hr", "10", "H", True, True, 1), ("118-hr-10", "118", "hr", "10", "House", True, True, 2), ("118-hr-9", "118", "hr", "9", None, False, None, 1)]
    got = bl.normalized(spark.createDataFrame(rows, BILLS), F.col("v")).collect()
    assert [(r["bill_id"], r["origin_chamber"], r["became_law"], r["v"]) for r in got] == [("118-hr-9", "", False, 1), ("118-hr-10", "house", True, 2), ("118-s-2", "senate", False, 1)]
    for bad in (("118-hr-1", "118", "hr", "2", "", None, None, 1), ("118-x-1", "118", "x", "1", "", None, None, 1), ("118-hr-1", "118", "hr", "1", "", False, True, 1), (None, "118", "hr", "1", "", None, None, 1)):
        with pytest.raises(PySparkException):
            bl.normalized(spark.createDataFrame([bad], BILLS)).collect()


def test_state_is_stored_pruned_and_survives_corruption(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = [turn(i, congress=100 + i % 3) for i in range(6)]
    t = frame(spark, rows).withColumn("shard", F.concat(F.lit("govinfo:"), F.col("congress").cast("string"))).withColumn("file", F.lit("f")).withColumn("pos", F.col("turn_id"))
    live = lambda *congresses: spark.createDataFrame([(f"govinfo:{c}", f"k{c}") for c in congresses], "shard string, files_key string")
    assert inc.load_state(spark, path) is None
    assert inc.update_state(spark, path, live(100, 101, 102), t, SCORER, "s").count() == 3
    assert inc.update_state(spark, path, live(100, 102), t, SCORER, "s").count() == 2  # the gone shard is pruned
    assert {r["shard"] for r in inc.load_state(spark, path).collect()} == {"govinfo:100", "govinfo:102"}
    inc.load_state(spark, path).limit(1).write.mode("overwrite").parquet(f"{path}/slot0")  # not the current slot
    assert inc.load_state(spark, path) is not None
    for slot in ("slot0", "slot1"):
        for f in (tmp_path / "state" / slot).glob("*.parquet"):
            f.write_bytes(b"torn")
    assert inc.load_state(spark, path) is None
    assert inc.update_state(spark, path, live(100, 101), t, SCORER, "s").count() == 2 and inc.load_state(spark, path).count() == 2


def test_settings_fingerprint_covers_patterns_but_not_titles(monkeypatch):
    before = inc.settings_fingerprint(SCORER)
    real = inc.inspect.getsource
    monkeypatch.setattr(inc.inspect, "getsource", lambda x: real(x).replace("lock", "block") if x is inc.scoring_module else real(x))
    assert inc.settings_fingerprint(SCORER) != before
    monkeypatch.undo()
    assert inc.settings_fingerprint(SCORER) == before != inc.settings_fingerprint(SCORER, procedural=True)


def test_chamber_mean_gap_is_first_party_less_second(spark):
    rows = [(2001, c, p, v) for c, p, v in (("house", "D", 5.0), ("house", "R", 2.0), ("senate", "D", 1.0), ("senate", "R", 2.0))] + [(2002, "house", "D", 1.0), (2002, "house", "R", 1.0)]
    got = ser.chamber_mean_gap(spark.createDataFrame(rows, "year int, chamber string, party string, rate double"), "rate", ["year"]).collect()
    assert [(r["year"], r["house"], r["senate"], r["gap"]) for r in got] == [(2001, 3.0, -1.0, 1.0)]


def test_ranks_are_average_ranks_over_all_rows(spark):
    values = [3, 1, 2, 2, 5, 5, 5, None, 9, 0]
    rows = spark.createDataFrame([(v, -v if v is not None else 1) for v in values], "a int, b int").repartition(3)
    got = {r["value"]: r["rank"] for r in rep.average_ranks(rows, "a").collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 3.5, 3: 5.0, 5: 7.0, 9: 9.0}
    assert rep.rank_correlations(rows, ["a", "b"]).first()["spearman"] == pytest.approx(-1.0)


def test_joins_of_annotations_are_one_to_one(spark):
    schema = "sample_id string, profanity string, confidence string, rationale string"
    a = spark.createDataFrame([("1", "yes", "low", "r"), ("2", "no", "low", "r")], schema)
    twice = a.unionByName(a.limit(1))
    with pytest.raises(PySparkException, match="repeated sample_id"):
        agr.agreement(a, twice, ("profanity",)).collect()
    with pytest.raises(ValueError, match="only in a"):
        agr.final_labels(a, a.filter("sample_id = '1'"), a.limit(0), ("profanity",))
    with pytest.raises(ValueError, match="not annotated"):
        agr.final_labels(a.limit(1), a.limit(1), a.withColumn("sample_id", F.lit("9")), ("profanity",))


def test_annotations_outside_their_vocabulary_fail_the_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sample_id,profanity,confidence,rationale\n1,Yes,low,because\n2,no,HIGH,x\n")
    assert {r["profanity"] for r in turn_files.read_annotations(spark, str(tmp_path)).collect()} == {"yes", "no"}
    (tmp_path / "a.csv").write_text("sample_id,profanity,confidence,rationale\n1,maybe,low,because\n")
    with pytest.raises(ValueError, match="maybe"):
        turn_files.read_annotations(spark, str(tmp_path))


def test_partitions_with_a_null_key_are_saved(spark, tmp_path):
    old = spark.createDataFrame([(None, "a"), (2, "b")], "congress int, v string")
    new = spark.createDataFrame([(None, "x"), (2, "b")], "congress int, v string")
    assert turn_files.save_partitions(None, old, "congress", str(tmp_path / "d")) == [None, 2]
    assert turn_files.save_partitions(old, new, "congress", str(tmp_path / "d")) == [None]


def test_profiles_and_metadata(spark, tmp_path):
    for name, day in (("hein_daily_101", "1990-01-01"), ("hein_daily_102", "1991-01-01"), ("govinfo_115", "2017-01-03")):
        frame(spark, [turn(1, date=day)]).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    profile = cov.source_profile(cov.file_profile(spark.read.parquet(str(tmp_path)), "date"))
    assert {(r["source"], r["files"], r["rows"], r["first_date"], r["last_date"]) for r in profile.collect()} == {("hein_daily", 2, 2, "1990-01-01", "1991-01-01"), ("govinfo", 1, 1, "2017-01-03", "2017-01-03")}
    table = spark.createDataFrame([("govinfo", 114, 2015), ("govinfo", 116, 2019), ("hein", 90, 1967)], "source string, congress int, year int")
    row = sinks.source_metadata(table).first()
    assert row["primary_boundary_year"] == 2019 and [s["source"] for s in row["sources"]] == ["govinfo", "hein"]


def test_mask_quotes_with_letters_as_marks(spark):
    spoken, inner = tx.mask_quotes(F.col("t"), "the", "of", 5)
    row = spark.createDataFrame([("a the x of b the far away of",)], "t string").select(spoken.alias("s"), inner.alias("q")).first()
    assert row["s"] == "a " + " " * 8 + " b the far away of" and row["q"] == " x "


def test_granule_mods_mark_what_is_no_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<mods xmlns="http://x"><titleInfo><title>Plain</title></titleInfo><extension><searchTitle>Search</searchTitle><congress>115</congress><granuleClass>HOUSE</granuleClass>
<dateIssued>2017-01-03</dateIssued><congMember bioGuideId="Z1" party="R" state="TX"><name type="parsed">Z</name></congMember><congMember bioGuideId="A1" party="D" state="MD"><name type="authority-lnf">A, B</name></congMember></extension>
<identifier type="congressional record citation">170 Cong. Rec. H5</identifier></mods>""")
    (tmp_path / "b.xml").write_text("<mods><broken>")
    got = {r["file"]: r for r in packages.read_granule_mods(spark, str(tmp_path)).collect()}
    assert (got["a.xml"]["title"], got["a.xml"]["citation"], got["a.xml"]["names"], got["a.xml"]["ids"], got["a.xml"]["parse_error"]) == ("Search", "170 Cong. Rec. H5", ["A, B", "Z"], ["A1", "Z1"], None)
    assert got["b.xml"]["parse_error"] and got["b.xml"]["title"] is None


def test_rest_bills_updates_and_resumed_batches(spark):
    import json

    one = {"congress": 118, "type": "HR", "number": "5", "originChamberCode": "H", "introducedDate": "2023-01-09", "url": "https://x.example/bill?api_key=SECRET", "sponsors": [{"bioguideId": "B1", "name": "N"}], "actions": [{"actionDate": "2023-02-01", "actionCode": "8000", "text": "Passed"}]}
    frame_of = lambda *items: spark.createDataFrame([(json.dumps(i),) for i in items], "payload string")
    bills = bl.rest_bills(frame_of(one, {"congress": "118", "type": "S", "number": 7}), "https://x.example/")
    got = {r["bill_id"]: r for r in bills.collect()}
    assert (got["118-hr-5"]["sponsor_name"], got["118-hr-5"]["passed_house"], got["118-hr-5"]["origin_chamber"], got["118-hr-5"]["source_url"]) == ("N", True, "house", "https://x.example/bill?api_key=***")
    assert got["118-s-7"]["source_url"] == "https://x.example/bill/118/s/7" and not got["118-s-7"]["became_law"]
    with pytest.raises(PySparkException, match="valid congress"):
        bl.rest_bills(frame_of({"type": "HR", "number": 5}), "https://x.example").collect()
    fresh = bills.filter("bill_id = '118-hr-5'").withColumn("title", F.lit("new"))
    ids = lambda d: [(r["bill_id"], r["title"]) for r in d.collect()]
    assert ids(bl.update_bills(bills, fresh, full=False)) == [("118-hr-5", "new"), ("118-s-7", "")] and ids(bl.update_bills(bills, fresh, full=True)) == [("118-hr-5", "new")]
    wanted = spark.createDataFrame([("118-hr-5",), ("118-hr-6",), ("118-s-7",), ("118-s-8",)], "bill_id string")
    checkpoint = spark.createDataFrame([("118-hr-5",), ("118-s-8",)], "bill_id string")
    assert [r[0] for r in bl.next_batch(wanted, checkpoint, bills, 2).collect()] == ["118-hr-6", "118-s-7"]


def test_scratch_tables_can_be_cleared(spark):
    from lectern.plans import scratch

    kept = scratch.stored(spark.range(3), "gone")
    assert kept.count() == 3 and scratch.clear(spark) and not scratch.clear(spark)
