"""Streaming state, resumed shards, observed counts and bucketed tables."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import incremental as inc
from lectern.operators import members as mem
from lectern.operators import resumable
from lectern.operators.dedup import keep_first
from lectern.sources import buckets, observed, staged, turn_files, zone_map
from lectern.streaming import member_state, turn_stream
from test_operators import SCORER, frame, turn


def many_turns(n=120):
    rng = random.Random(4)
    texts = ["a damn thing", "he said ``a damn lie'' and left", "liar", "", None, "bribery and crap"]
    return [
        turn(i, bioguide=rng.choice(["B1", "B2 ", "B3", "", None]), date=rng.choice(["2017-01-03", "2017-01-04", "1995-03-01", "bad"]), chamber=rng.choice(["house", "senate", None]), congress=rng.choice([115, 104, None]),
             speaker_name=rng.choice(["Ann", "", None, "Bob"]), party=rng.choice(["D", "R", "", None]), state=rng.choice(["TX", None]), text=rng.choice(texts), is_procedural=rng.random() < 0.1)
        for i in range(n)
    ]


def as_batch(spark, turns):
    """The batch operator over each id once, in the order of ids."""
    return mem.member_day(mem.score_spoken(mem.attributed(frame(spark, turns)).withColumn("pos", F.col("turn_id")), SCORER))


def table(rows):
    return sorted(tuple(sorted(r.asDict().items())) for r in rows.collect())


def test_streaming_state_equals_the_batch_and_is_safe_to_replay(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    turns = many_turns()
    random.Random(7).shuffle(turns)
    parts = [turns[:50], turns[50:90] + turns[10:30], turns[90:] + turns[95:100]]  # repeated ids within and across batches
    for k, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.mode("append").parquet(src)
        member_state.start(spark, src, out, check, SCORER).awaitTermination()
        seen = {t[0]: t for p in parts[: k + 1] for t in p}
        assert table(member_state.member_days(spark, out)) == table(as_batch(spark, list(seen.values())))
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").glob("epoch=*"))
    replay = spark.read.parquet(f"{out}/epoch={last}").collect()
    spark.createDataFrame(replay, member_state.CHANGE).write.mode("overwrite").parquet(f"{out}/epoch={last}")  # the same epoch again
    assert table(member_state.member_days(spark, out)) == table(as_batch(spark, turns))
    member_state.compact(spark, out, str(tmp_path / "small"))
    small = member_state.member_days(spark, str(tmp_path / "small"))
    assert table(small) == table(as_batch(spark, turns)) and spark.read.parquet(str(tmp_path / "small")).count() < spark.read.parquet(out).count()


def test_recomputed_days_and_appends_do_not_depend_on_partitions(spark, tmp_path):
    turns = many_turns(40)
    doubled = turns + [t[:3] + (117,) + t[4:] for t in turns[:20]]
    made = []
    for k in (1, 7):
        random.Random(k).shuffle(doubled)
        rows = frame(spark, doubled).repartition(k)
        made.append(table(turn_stream.recompute_days(rows, rows, SCORER)))
        out = str(tmp_path / f"t{k}")
        assert turn_files.append_new(rows, out) == 40
        made.append(sorted(map(str, spark.read.parquet(out).drop("congress_key").collect())))
    assert made[0] == made[2] and made[1] == made[3]


def shards(spark, n=6):
    rows = [turn(i, congress=100 + i % n, text="damn liar" if i % 2 else "my good friend") for i in range(40)] + [turn(0, congress=100)]
    t = frame(spark, rows).withColumn("shard", F.concat(F.lit("govinfo:"), F.col("congress").cast("string"))).withColumn("file", F.lit("f")).withColumn("pos", F.monotonically_increasing_id())
    current = lambda key="k": spark.createDataFrame([(f"govinfo:{100 + c}", f"{key if c == 1 else 'k'}{c}") for c in range(n)], "shard string, files_key string")
    return t, current


class Stopped(Exception):
    pass


def test_a_stopped_run_scores_only_what_is_left(spark, tmp_path):
    path = str(tmp_path / "state")
    t, current = shards(spark)
    done = []

    def stop_after_two(wave):
        done.extend(wave)
        if len(done) == 2:
            raise Stopped

    with pytest.raises(Stopped):
        resumable.run(spark, path, current(), t, SCORER, "s", 1, stop_after_two)
    inc.shard_sums(t.filter("shard = 'govinfo:103'"), SCORER).write.parquet(f"{path}/waves/lost")  # written, and killed before its commit
    later = []
    state = resumable.run(spark, path, current(), t, SCORER, "s", 1, later.extend)
    assert len(done) == 2 and sorted(done + later) == [f"govinfo:{100 + c}" for c in range(6)]
    full = inc.shard_sums(t, SCORER)
    assert table(state.select(*full.columns)) == table(full)
    again = []
    assert table(resumable.run(spark, path, current(), t, SCORER, "s", 1, again.extend).select(*full.columns)) == table(full) and again == []
    changed = resumable.run(spark, path, current("new"), t, SCORER, "s", 1_000, again.extend)
    assert again == ["govinfo:101"] and table(changed.select(*full.columns)) == table(full)
    assert sorted(map(len, resumable.waves([("a", 3), ("b", 9), ("c", 1), ("d", 0)], 5))) == [2, 2]


def test_counts_are_observed_in_the_pass_that_writes(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    rows = frame(spark, [turn(1), turn(2, is_procedural=True, word_count=5), turn(3, party="I", congress=116), turn(4, party="other"), turn(5, text=None), turn(6, date="x")])
    rows = rows.withColumn("bad", F.col("text").isNull())
    counts = observed.publish_observed(rows, root, malformed=F.col("bad"), rejected=F.length("date") != 10, max_rejected=2)
    assert counts == {
        "rows": 6, "malformed": 1, "rejected": 1, "total_turns": 4, "total_words": 14, "procedural_turns": 1, "procedural_words": 5,
        "nonprocedural_turns": 3, "nonprocedural_words": 9, "analysis_party_turns": 2, "analysis_party_words": 6,
    }
    assert sorted(r["turn_id"] for r in staged.read(spark, root).collect()) == ["t1", "t2", "t3", "t4"]
    before = staged.current_run(spark, root)
    for bad, limit in ((rows, 1), (rows.limit(0), 0)):
        with pytest.raises(ValueError, match="rejected|no turns"):
            observed.publish_observed(bad, root, malformed=F.col("bad"), rejected=F.length("date") != 10, max_rejected=limit)
    assert staged.current_run(spark, root) == before


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_bucketed_tables_need_no_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        turns = [(f"t{k % 150}", k, f"text {k}") for k in range(400)]
        t = spark.createDataFrame(turns, "turn_id string, pos long, text string")
        buckets.write_buckets(t, "bucketed_turns", "turn_id", 4)
        first = buckets.first_of_each(spark, "bucketed_turns", "turn_id", [F.col("pos")])
        assert exchanges(first) == 0
        assert table(first) == table(keep_first(t, ["turn_id"], [F.col("pos")]))
        keys = ["congress", "speech_id"]
        s = spark.createDataFrame([(97 + k % 2, f"s{k}", f"speech {k}") for k in range(60)], "congress int, speech_id string, text string")
        d = spark.createDataFrame([(97 + k % 2, f"s{k % 40}", k, f"d{k}") for k in range(80)], "congress int, speech_id string, pos long, speaker string")
        m = spark.createDataFrame([(97 + k % 2, f"s{k % 30}", k, f"m{k}") for k in range(90)], "congress int, speech_id string, pos long, party string")
        for name, rows in (("speeches", s), ("descriptions", d), ("speakers", m)):
            buckets.write_buckets(rows, f"bucketed_{name}", keys, 4)
        joined = buckets.speech_lookups(spark, *(f"bucketed_{n}" for n in ("speeches", "descriptions", "speakers")))
        assert exchanges(joined) == 0
        plain = s.join(keep_first(d, keys, [F.col("pos").desc()]).drop("pos"), keys, "left").join(keep_first(m, keys, [F.col("pos").desc()]).drop("pos"), keys, "left")
        assert table(joined.na.fill("")) == table(plain.na.fill("")) and joined.count() == 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("turns", "speeches", "descriptions", "speakers"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")


def test_logged_failures_are_resolved_against_the_corpus(spark, tmp_path):
    path = str(tmp_path / "turns")
    for day in ("2020-01-02", "2020-02-03", "2020-03-04"):
        spark.createDataFrame([(day, "x")], "date string, text string").coalesce(1).write.mode("append").parquet(path)
    zones = zone_map.refresh(spark, path, "date", str(tmp_path / "map"))
    log = spark.createDataFrame([("CREC-2020-01-02 failed",), ("2020 CREC-2020-01-09 CREC-2026-13-99",), ("CREC-2020-02-03-v2",), ("xCREC-2020-05-05",), (None,)], "value string")
    found = zone_map.still_failed(log, zones)
    assert [r["package"] for r in found.values.collect()] == ["CREC-2020-01-09"] and (found.opened, found.skipped) == (2, 1)
