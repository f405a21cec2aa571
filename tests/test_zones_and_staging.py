"""Zone maps equal scans and spare files; a staged run is seen whole or not at all."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import coverage
from lectern.sources import staged, zone_map


def days_table(spark, path, months=range(1, 13)):
    for m in months:
        rows = [(f"2020-{m:02}-{d:02}", f"t{m}-{d}") for d in range(1, 29) if (m + d) % 5]
        spark.createDataFrame(rows, "date string, text string").coalesce(1).write.mode("append").parquet(path)


def test_zone_maps_equal_scans_and_open_few_files(spark, tmp_path):
    path, map_path = str(tmp_path / "turns"), str(tmp_path / "map")
    days_table(spark, path)
    zones = zone_map.refresh(spark, path, "date", map_path)
    table = spark.read.parquet(path)
    assert zone_map.bounds(zones).first().asDict() == {"low": "2020-01-01", "high": "2020-12-27", "unknown": 0}
    scan = {r["file"]: (r["rows"], r["first_date"], r["last_date"], r["bytes"]) for r in coverage.file_profile(table, "date").collect()}
    assert {r["file"]: (r["rows"], r["first"], r["last"], r["bytes"]) for r in zone_map.file_profile(zones).collect()} == scan
    wanted = spark.createDataFrame([(d,) for d in ("2020-03-02", "2020-03-03", "2020-03-30", "2020-07-03", "2021-01-01", "1999-12-31", None)], "day string")
    found = zone_map.missing_values(spark, zones, "date", wanted, "day")
    assert sorted(r[0] or "" for r in found.values.collect()) == sorted(r[0] or "" for r in coverage.missing(wanted, table.select(F.col("date").alias("day")), "day").distinct().collect())
    assert (found.opened, found.skipped) == (2, 10)
    none = zone_map.missing_values(spark, zones, "date", wanted.filter("day > '2020-12-31'"), "day")
    assert (none.values.count(), none.opened, none.skipped) == (1, 0, 12)


def test_zone_maps_open_only_new_files(spark, tmp_path, monkeypatch):
    path, map_path = str(tmp_path / "turns"), str(tmp_path / "map")
    days_table(spark, path, range(1, 4))
    first = zone_map.refresh(spark, path, "date", map_path).count()
    seen = []
    real = zone_map.read_zones
    monkeypatch.setattr(zone_map, "read_zones", lambda files, column: seen.append(files.count()) or real(files, column))
    days_table(spark, path, range(4, 5))
    (next((tmp_path / "turns").glob("part-*.parquet"))).unlink()
    zones = zone_map.refresh(spark, path, "date", map_path)
    assert first == 3 and seen == [1] and zones.count() == 3
    assert zone_map.bounds(zones).first()["high"] == "2020-04-28"


def test_zones_without_statistics_columns_or_values(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("2020-01-05", "x")], "date string, text string").coalesce(1).write.option("parquet.column.statistics.enabled", "false").parquet(path)
    spark.createDataFrame([(None, "x")], "date string, text string").coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("no date",)], "text string").coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("not a day", "x"), ("zzz", "y")], "date string, text string").coalesce(1).write.mode("append").parquet(path)
    zones = zone_map.refresh(spark, path, "date", str(tmp_path / "map"))
    wanted = spark.createDataFrame([("2020-01-05",), ("2020-01-06",), ("odd",)], "day string")
    found = zone_map.missing_values(spark, zones, "date", wanted, "day")
    assert sorted(r[0] for r in found.values.collect()) == ["2020-01-06", "odd"] and found.opened + found.skipped == 4 and found.skipped >= 2


def rows(spark, values):
    return spark.createDataFrame(values, "congress int, v string")


def content(spark, root):
    table = staged.read(spark, root)
    return None if table is None else sorted(tuple(r) for r in table.select("congress", "v").collect())


def test_readers_see_a_run_whole_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    assert content(spark, root) is None and staged.verify(spark, root) == 0
    staged.publish(rows(spark, [(115, "a"), (115, "b"), (116, "c"), (None, "n")]), root, "congress", "one")
    first = [(115, "a"), (115, "b"), (116, "c"), (None, "n")]
    keyed = lambda x: sorted(x, key=str)
    assert keyed(staged.read(spark, root).select("congress", "v").collect()) == keyed(first)
    before = staged.read(spark, root)
    killed = staged.stage(rows(spark, [(116, "C"), (117, "d")]), root, "congress", "two")  # and killed before the switch
    assert killed.partitions == ["congress_key=116", "congress_key=117"]
    assert keyed(staged.read(spark, root).select("congress", "v").collect()) == keyed(first) and staged.current_run(spark, root) == "one"
    staged.switch(spark, killed)
    assert keyed(staged.read(spark, root).select("congress", "v").collect()) == keyed([(115, "a"), (115, "b"), (116, "C"), (117, "d"), (None, "n")])
    assert keyed(before.select("congress", "v").collect()) == keyed(first)  # a reader keeps the files it started with
    runs = {r["path"].split("/runs/")[1].split("/")[0] for r in staged.snapshot(spark, root).collect()}
    assert runs == {"one", "two"} and staged.verify(spark, root) == 4


def test_unused_runs_are_swept_and_damage_is_named(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    staged.publish(rows(spark, [(1, "a")]), root, "congress", "one")
    staged.stage(rows(spark, [(2, "b")]), root, "congress", "lost")
    staged.publish(rows(spark, [(1, "z"), (2, "y")]), root, "congress", "two")
    assert staged.sweep(spark, root) == ["lost", "one"] and staged.verify(spark, root) == 2
    assert staged.stage(rows(spark, []), root, "congress", "nothing").partitions == []
    file = next((tmp_path / "table" / "runs" / "two").rglob("part-*.parquet"))
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(data)
    (file.parent / f".{file.name}.crc").unlink()  # the local file system's own check
    with pytest.raises(staged.DamagedTable, match="not what was published"):
        staged.verify(spark, root)
    file.unlink()
    with pytest.raises(staged.DamagedTable, match="missing"):
        staged.verify(spark, root)
