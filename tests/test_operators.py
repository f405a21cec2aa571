"""Dedup, members, bills, segments, incremental state, sources and the stream on small fixtures."""

import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from lectern.functions.scoring import Scorer, score_turns
from lectern.operators import bills as bl
from lectern.operators import dedup as dd
from lectern.operators import incremental as inc
from lectern.operators import members as mem
from lectern.operators import metrics as met
from lectern.operators import sampling as smp
from lectern.operators import segments as seg
from lectern.schema import TURN, conform
from lectern.sources import bill_status, delimited, packages, turn_files

SCORER = Scorer.sample()


def turn(i, **more):
    base = {"turn_id": f"t{i}", "source": "govinfo", "date": "2017-01-03", "congress": 115, "chamber": "house", "speaker_name": "A", "bioguide": "B1", "party": "D", "state": "TX", "is_procedural": False, "text": "a damn thing", "word_count": 3}
    row = base | more
    return tuple(row.get(f.name) for f in TURN)


def frame(spark, rows):
    return spark.createDataFrame(rows, TURN)


def test_first_wins_only_in_scope(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 0, True), ("b", 0, False), ("b", 1, False)], "turn_id string, r int, s boolean")
    got = sorted((x["turn_id"], x["r"]) for x in dd.first_wins(rows, F.col("r"), scope=F.col("s")).collect())
    assert got == [("a", 0), ("b", 0), ("b", 1)]


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string")
    new = spark.createDataFrame([(2, "n1"), (2, "n2"), (3, "n")], "k int, v string")
    assert sorted(map(tuple, dd.upsert(old, new, ["k"], [F.col("v")]).collect())) == [(1, "o"), (2, "n2"), (3, "n")]
    assert dd.replace_groups(old, new, "k").count() == 4


def test_incremental_equals_full_and_reuses_valid_shards(spark):
    rows = [turn(i, congress=100 + i % 3, text="damn liar" if i % 2 else "my good friend") for i in range(12)] + [turn(0, congress=100)]
    t = frame(spark, rows).withColumn("shard", F.concat(F.lit("govinfo:"), F.col("congress").cast("string"))).withColumn("file", F.lit("f")).withColumn("pos", F.monotonically_increasing_id())
    files = lambda change: spark.createDataFrame([(f"govinfo:{c}", f"key{c}{change if c == 101 else ''}") for c in (100, 101, 102)], "shard string, files_key string")
    key = inc.settings_fingerprint(SCORER, procedural=False)
    state = inc.refresh(None, files(""), t, SCORER, key)
    full = met.sum_scores(score_turns(met.with_groups(met.substantive(dd.first_wins(t, F.col("pos")))), SCORER))
    as_set = lambda d: sorted(map(str, d.select(*full.columns).collect()))
    assert as_set(inc.totals(state)) == as_set(full)
    marked = state.withColumn("turns", F.col("turns") + 1000)
    again = inc.refresh(marked, files("x"), t, SCORER, key)
    assert {r["shard"]: r["turns"] >= 1000 for r in again.collect()} == {"govinfo:100": True, "govinfo:101": False, "govinfo:102": True}
    assert inc.refresh(marked, files(""), t, SCORER, "other").filter("turns >= 1000").count() == 0


def test_member_day_takes_latest_attributes(spark):
    rows = [turn(1, date="2017-01-03", speaker_name="Old", state="TX", party="D"), turn(2, date="2017-01-05", speaker_name="", state="", party=None), turn(3, bioguide=" "), turn(4, is_procedural=True)]
    t = mem.attributed(frame(spark, rows)).withColumn("pos", F.col("turn_id"))
    got = mem.member_day(mem.score_spoken(t, SCORER)).orderBy("date").collect()
    assert [(r["date"], r["turns"], r["profanity_hits"], r["speaker_name"], r["state"], r["party"]) for r in got] == [("2017-01-03", 1, 1, "Old", "TX", "other"), ("2017-01-05", 1, 1, "Old", "TX", "other")]


def test_quoted_profanity_counts_apart(spark):
    t = mem.attributed(frame(spark, [turn(1, text="he said ``damn crap'' and damn")])).withColumn("pos", F.col("turn_id"))
    row = mem.member_day(mem.score_spoken(t, SCORER)).first()
    assert (row["profanity_hits"], row["profanity_quoted_hits"]) == (1, 2)


def test_board_thresholds_and_ties(spark):
    rows = spark.createDataFrame([("b", 10, 2), ("a", 10, 2), ("c", 30, 1), ("d", 5, 9)], "bioguide string, words int, turns int")
    got = mem.board(rows, ["words", "turns"], 3, F.col("words") >= 10).orderBy("rank").collect()
    assert [(r["rank"], r["bioguide"]) for r in got] == [(1, "c"), (2, "a"), (3, "b")]


def test_milestones_by_code_and_text(spark):
    a = [("2020-02-01", "8000", ""), ("2020-01-01", None, "Passed/agreed to in House: On motion"), ("2020-03-01", "17000", None), ("2020-04-01", "", "Became Public Law No: 116-1."), (None, "5", "Motion passed House rules")]
    row = spark.createDataFrame([(a,)], f"actions array<{bl.ACTION}>").select(*(v.alias(k) for k, v in bl.milestones(F.col("actions")).items())).first()
    assert row["passed_house_date"] == "2020-01-01" and row["passed_senate"] and row["became_law_date"] == "2020-04-01"
    assert row["matched_action_codes"] == '["17000", "8000"]'


def test_law_of_own_congress_first(spark):
    laws = [("Public Law", "bad"), ("Public Law", "115-7"), ("Private Law", "116-2"), ("Other", "116-1")]
    row = spark.createDataFrame([(laws,)], "laws array<struct<type:string,number:string>>").select(bl.chosen_law(F.col("laws"), F.lit(116)).alias("l"), bl.chosen_law(F.col("laws"), F.lit(99)).alias("m")).first()
    assert (row["l"]["number"], row["m"]["number"]) == ("116-2", "115-7")


TEXT = """[Congressional Record Volume 1]
[House]

  Opening words.
  Mr. VAN HOLLEN of Maryland. I rise today.
  There being no objection, the letter was ordered to be printed in the Record, as follows:
  Dear all.
  The SPEAKER pro tempore. The time has expired.
  Ms. SMITH. Thank you.
"""
MEMBERS = [("D", "V1", "Chris Van Hollen", "MD"), ("R", "S1", "Smith, Ann", "TX"), ("D", "S2", "Bob Smith", "CA")]


def test_segments_attribution_and_inserted_material(spark):
    g = spark.createDataFrame([("G1", "2017-01-03", 115, "house", TEXT, MEMBERS)], "granule_id string, date string, congress int, chamber string, text string, members array<struct<party:string,bioguide:string,name:string,state:string>>")
    got = {r["turn_id"]: r for r in seg.turns_of(g).collect()}
    assert set(got) == {"crec:G1#0", "crec:G1#1", "crec:G1#1-inserted", "crec:G1#2", "crec:G1#3"}
    assert got["crec:G1#0"]["text"] == "Opening words." and got["crec:G1#0"]["speaker_name"] == ""
    assert (got["crec:G1#1"]["bioguide"], got["crec:G1#1"]["party"], got["crec:G1#1"]["text"]) == ("V1", "D", "I rise today.")
    assert got["crec:G1#1-inserted"]["is_procedural"] and got["crec:G1#2"]["is_procedural"]
    assert (got["crec:G1#3"]["bioguide"], got["crec:G1#3"]["party"]) == ("", "other")  # two Smiths


MODS = """<mods xmlns="http://x"><extension><congress>115</congress></extension>
<relatedItem type="constituent" ID="id-CREC-2017-01-03-pt1-PgH1"><extension><granuleClass>HOUSE</granuleClass><chamber>HOUSE</chamber>
<congMember bioGuideId="V1" party="D" state="MD"><name type="authority-fnf">Chris Van Hollen</name></congMember></extension></relatedItem></mods>"""


def test_package_to_turns(spark, tmp_path):
    body = "Mr. VAN HOLLEN. " + "Words of the day. " * 40
    with zipfile.ZipFile(tmp_path / "CREC-2017-01-03.zip", "w") as z:
        z.writestr("CREC-2017-01-03/mods.xml", MODS)
        z.writestr("CREC-2017-01-03/CREC-2017-01-03-pt1-PgH1.htm", f"<html><body><pre>\n  {body}\n  {body}\n</pre></body></html>")
    turns = packages.package_turns(packages.read_packages(spark, str(tmp_path))).collect()
    assert len(turns) == 1  # the repeated long turn counts once
    assert (turns[0]["congress"], turns[0]["bioguide"], turns[0]["chamber"], turns[0]["date"]) == (115, "V1", "house", "2017-01-03")


def test_html_text(spark):
    row = spark.createDataFrame([("<body>x<pre>a &lt;b&gt;  \n\n\n\nc</pre></body>",), ("<p>no <b>pre</b> &amp; more</p>",)], "h string").select(packages.html_text(F.col("h")).alias("t")).collect()
    assert [r["t"] for r in row] == ["a <b>\n\nc\n", "no pre & more\n"]


def test_manifest_counts_malformed_and_merges(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"granuleId": "a", "backfilled": true}\n\nnot json\n{"granuleId": "a"}\n{"granuleId": "b"}\n')
    rows = packages.read_manifest(spark, str(tmp_path)).cache()
    assert rows.filter("_corrupt_record IS NOT NULL").count() == 1
    assert sorted((r["granuleId"], r["backfilled"]) for r in packages.merge_manifests(rows).collect()) == [("a", None), ("b", None)]


def test_delimited_speeches(spark, tmp_path):
    def put(name, lines):
        (tmp_path / name).write_bytes("\r\n".join(lines).encode("latin-1"))
        return str(tmp_path / name)

    s = put("speeches_097.txt", ["speech_id|speech", "1|caf\xe9 | bar", "2|", "", "3|third one"])
    d = put("descr_097.txt", ["speech_id|chamber|date|n|speaker|f|l|state|g|a|b|c|e|word_count", "1|H|19810105|1|Mr. X|||TX|||||| 7".replace(" 7", "7"), "3|S|bad|1||||||||||x", "9|short"])
    m = put("097_SpeakerMap.txt", ["speakerid|speech_id|lastname|firstname|chamber|state|gender|party|district|nonvoting", "77|3|DOE|JANE|S|NY|F|200|1|voting"])
    got = {r["turn_id"]: r for r in delimited.speech_turns(spark, s, d, m, "daily").collect()}
    assert got["hein_daily:1"]["text"] == "café | bar" and got["hein_daily:1"]["date"] == "1981-01-05" and got["hein_daily:1"]["word_count"] == 7
    assert (got["hein_daily:3"]["speaker_name"], got["hein_daily:3"]["party"], got["hein_daily:3"]["chamber"], got["hein_daily:3"]["word_count"]) == ("JANE DOE", "R", "senate", 2)
    assert got["hein_daily:2"]["text"] == "" and got["hein_daily:2"]["congress"] == 97


XML = """<billStatus><bill><congress>118</congress><{t}>HR</{t}><{n}>5</{n}><title>T</title><originChamber>House</originChamber><introducedDate>2023-01-09</introducedDate>
<sponsors><item><bioguideId>B1</bioguideId><fullName>N</fullName><party>D</party><state>TX</state></item></sponsors>
<actions><item><actionDate>2023-02-01</actionDate><actionCode>8000</actionCode><text>Passed</text></item></actions><laws><item><type>Public Law</type><number>118-3</number></item></laws></bill></billStatus>"""


@pytest.mark.parametrize(("t", "n"), [("type", "number"), ("billType", "billNumber")])
def test_bill_xml_of_both_generations(spark, tmp_path, t, n):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("BILLSTATUS-118hr5.xml", XML.format(t=t, n=n))
    row = bill_status.parse_bills(bill_status.read_archives(spark, str(tmp_path))).first()
    assert (row["bill_id"], row["sponsor_bioguide"], row["passed_house"], row["became_law"], row["law_number"]) == ("118-hr-5", "B1", True, True, "118-3")
    assert bl.violations(spark.createDataFrame([row])).count() == 0


def test_listing(spark):
    xml = "<data><files><file><name>BILLSTATUS-118s2.xml</name><link>v</link><formattedLastModifiedTime>2024-01-01T00:00:00</formattedLastModifiedTime></file><file><name>BILLSTATUS-118hr12.xml</name><link>u</link><formattedLastModifiedTime>07-Jan-2024 03:04</formattedLastModifiedTime></file><file><name>x.zip</name></file></files></data>"
    got = spark.createDataFrame([(xml,), ("<data/>",)], "x string").select(bill_status.parse_listing(F.col("x")).alias("f")).collect()
    assert [tuple(f) for f in got[0]["f"]] == [(118, "hr", 12, "u", "2024-01-07T03:04:00"), (118, "s", 2, "v", "2024-01-01T00:00:00")] and got[1]["f"] == []


def test_zipped_speeches_equal_plain_ones(spark, tmp_path):
    files = {"speeches_097.txt": "speech_id|speech\r\n1|caf\xe9 | bar\r\n2|\r\n", "descr_097.txt": "speech_id|h\r\n1|H|19810105|1|Mr. X|||TX||||||7\r\n", "097_SpeakerMap.txt": "speakerid|h\r\n77|2|DOE|JANE|S|NY|F|200|1|v\r\n"}
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "a.zip", "w") as z:
        for name, text in files.items():
            z.writestr(f"hein-daily/{name}", text.encode("latin-1"))
            (tmp_path / name).write_bytes(text.encode("latin-1"))
    a = delimited.zipped_turns(spark, str(tmp_path / "z"), "daily")
    b = delimited.speech_turns(spark, *(str(tmp_path / n) for n in files), "daily")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == 2
    assert delimited.available_congresses(spark, str(tmp_path)) == [97]


def test_publish_guards_and_missing_tables(spark, tmp_path):
    assert turn_files.load_partitions(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError, match="rejected"):
        turn_files.publish(frame(spark, [turn(1)]), {"manifest_rows": 10, "malformed_json": 1}, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no turns"):
        turn_files.publish(frame(spark, []), {"manifest_rows": 10}, str(tmp_path / "t"))
    stats = turn_files.publish(frame(spark, [turn(1)]), {"manifest_rows": 2, "invalid_rows": 1}, str(tmp_path / "t"), str(tmp_path / "stats"), max_rejected=1)
    assert stats["turns_written"] == 1 and spark.read.json(str(tmp_path / "stats")).first()["invalid_rows"] == 1


def test_scalar_functions(spark):
    from lectern.functions import domain as dom

    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert [get(dom.ordinal(F.lit(n))) for n in (1, 2, 3, 11, 112, 113, 121)] == ["1st", "2nd", "3rd", "11th", "112th", "113th", "121st"]
    assert get(dom.congress_of_year(F.lit(1788))) == 0 and get(dom.congress_of_year(F.lit(2024))) == 118
    assert get(dom.congress_or_date(F.lit("0"), F.lit("1995-01-03"))) == 104 and get(dom.congress_or_date(F.lit(None), F.lit(""))) == 0
    assert get(dom.iso_date(F.lit("19950103"))) == "1995-01-03" and get(dom.iso_date(F.lit("x"))) == "x"
    assert get(dom.without_key(F.lit("http://x/?a=1&api_key=SECRET&b=2"))) == "http://x/?a=1&api_key=***&b=2"
    assert get(dom.is_newer(F.lit("2024-01-01T05:00:00+05:00"), F.lit("2024-01-01T00:00:00Z"))) is False
    assert get(dom.is_newer(F.lit("bad"), F.lit("2024"))) is True
    assert get(dom.passage(F.lit("abcdefghij"), F.lit(9), 4)) == "ghij" and get(dom.passage(F.lit("ab"), F.lit(1), 4)) == "ab"
    assert get(dom.newest_stamp(F.lit("2024-01-01"), F.lit("bad"), F.lit("2024-03-01T10:00:00"))) == "2024-03-01T10:00:00Z"
    assert get(dom.bill_url("https://x.example/", F.lit(118), F.lit("HR"), F.lit(5))) == "https://x.example/118th-congress/house-bill/5"
    assert get(dom.surname(F.lit("Smith, Ann"))) == "SMITH" and get(dom.era_of(F.lit(1945))) == "1901-1945"


def test_turn_files_round_trip(spark, tmp_path):
    out = str(tmp_path / "turns")
    turn_files.write_turns(frame(spark, [turn(1), turn(2, congress=116)]), out)
    back = turn_files.read_turns(spark, out)
    assert back.count() == 2 and conform(back).schema == TURN
    assert turn_files.append_new(frame(spark, [turn(2), turn(3), turn(3)]), out) == 1


def test_only_changed_partitions_are_rewritten(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "congress int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "congress int, v string")
    assert turn_files.save_partitions(None, old, "congress", str(tmp_path / "d")) == [1, 2]
    assert turn_files.save_partitions(old, new, "congress", str(tmp_path / "d")) == [2, 3]


def test_sample_is_stable_and_holds_its_signal(spark):
    t = frame(spark, [turn(i, text=("x " * 900) + "damn liar" if i % 2 else "nothing", is_procedural=i % 5 == 0) for i in range(30)])
    blinded, hidden = smp.validation_sample(t, SCORER, 3, 2)
    again, _ = smp.validation_sample(t.repartition(7), SCORER, 3, 2)
    ids = lambda d: sorted(r["sample_id"] for r in d.select("sample_id").collect())
    assert ids(blinded) == ids(again)
    for r in hidden.collect():
        kind = r["sampling_stratum"].rsplit("|", 1)[-1]
        if kind in smp.SIGNAL_SCORE:
            assert r[smp.SIGNAL_SCORE[kind]] > 0


def test_windows_of_days():
    assert inc.repair_window(date(2024, 1, 10), date(2024, 1, 12)) == (date(2024, 1, 7), date(2024, 1, 12))
    assert inc.next_window(date(2024, 1, 12), date(2024, 1, 12), date(2020, 1, 1)) is None
    assert inc.routine_congresses(date(2025, 1, 10)) == [118, 119] and inc.routine_congresses(date(2025, 1, 15)) == [119]


def test_stream_recomputes_touched_days(spark, tmp_path):
    from lectern.streaming import turn_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame(spark, [turn(1), turn(2, date="2017-01-04")]).write.parquet(src)
    for extra in (None, [turn(3), turn(1)]):
        if extra:
            frame(spark, extra).write.mode("append").parquet(src)
        turn_stream.start(spark, src, out, str(tmp_path / "ck"), SCORER).awaitTermination()
    got = {r["date"]: r["turns"] for r in spark.read.parquet(out).collect()}
    assert got == {"2017-01-03": 2, "2017-01-04": 1}


def test_stream_takes_old_files_after_new_ones(spark, tmp_path):
    from lectern.streaming import turn_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([turn(1)], [turn(2, date="2017-01-04")], [turn(3, date="1995-03-01"), turn(4, date="1995-03-01")]):
        frame(spark, part).write.mode("append").parquet(src)
        turn_stream.start(spark, src, out, str(tmp_path / "ck"), SCORER).awaitTermination()
    got = {r["date"]: r["turns"] for r in spark.read.parquet(out).collect()}
    assert got == {"2017-01-03": 1, "2017-01-04": 1, "1995-03-01": 2}


def test_html_text_decodes_all_references(spark):
    import html

    pages = ["It&#8217;s caf&#233; &#x2014; &eacute;t&eacute;&mdash;&hellip; &copy; &middot;", "&amp;lt; &amp;#233; &lt;b&gt; &quot;x&quot; &#39;&apos;", "no references", "R&D & AT&T &unknown; &#x1D54F;", "x&nbsp;y&#160;z"]
    rows = spark.createDataFrame([*((i, f"<pre>{p}</pre>") for i, p in enumerate(pages)), (len(pages), None)], "i int, h string").select("i", packages.html_text(F.col("h")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == [*(html.unescape(p) + "\n" for p in pages), None]


def test_zip_helper_is_real():
    assert zipfile.is_zipfile(io.BytesIO(b"PK\x05\x06" + b"\0" * 18))
