"""Archives by range: every member by some task, equal rows, bounded pieces, damage named."""

import io
import random
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lectern.sources import archives, packages


def make(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)


def test_members_equal_a_plain_reader_and_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "TASK_BYTES", 20_000)
    rng = random.Random(2)
    files = {f"d/{k:03}.bin": rng.randbytes(rng.choice([0, 1, 500, 9_000])) for k in range(150)} | {"empty/": b"", "big.txt": b"line one\r\n" * 300_000}
    make(tmp_path / "one.zip", files)
    make(tmp_path / "two.zip", {"stored.txt": b"as it is", "d/000.bin": b"other"}, zipfile.ZIP_STORED)
    found = archives.index(spark, str(tmp_path))
    rows = archives.contents(found).withColumn("task", F.spark_partition_id()).collect()
    got = {(r["archive"].rsplit("/", 1)[-1], r["member"]): bytes(r["content"]) for r in rows}
    want = {("one.zip", k): v for k, v in files.items() if not k.endswith("/")} | {("two.zip", "stored.txt"): b"as it is", ("two.zip", "d/000.bin"): b"other"}
    assert got == want and len(rows) == len(want)
    assert len({r["task"] for r in rows if r["archive"].endswith("one.zip")}) > 10  # one archive, many tasks
    order = {}
    for r in rows:
        order.setdefault((r["task"], r["archive"]), []).append(r["offset"])
    assert all(v == sorted(v) for v in order.values())


def test_lines_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "READ_BYTES", 37)
    texts = {"a.txt": "one\ntwo\r\n\ncaf\xe9 | x\nlast", "b.txt": "", "c.txt": "\n", "d.txt": "no end", "e.txt": "".join(f"line {k}\r\n" for k in range(25_000))}
    make(tmp_path / "t.zip", {k: v.encode("latin-1") for k, v in texts.items()})
    got = {}
    for r in archives.lines(archives.index(spark, str(tmp_path))).orderBy("member", "pos").collect():
        assert r["pos"] == len(got.setdefault(r["member"], []))
        got[r["member"]].append(r["line"])
    want = {k: [x.rstrip("\r\n") for x in io.StringIO(v, newline="\n")] for k, v in texts.items() if v}
    assert got == want


@pytest.mark.parametrize("damage", ["flip", "cut", "crypt"])
def test_damaged_members_are_named(spark, tmp_path, damage):
    make(tmp_path / "bad.zip", {"fine.txt": b"fine" * 50, "hurt.txt": random.Random(1).randbytes(4_000)}, zipfile.ZIP_STORED)
    found = archives.index(spark, str(tmp_path)).filter("member = 'hurt.txt'")
    at = found.first()["offset"]
    data = bytearray((tmp_path / "bad.zip").read_bytes())
    if damage == "flip":
        data[at + 500] ^= 255
    elif damage == "cut":
        data = data[: at + 700]
    else:
        data[at + 6] |= 1
    (tmp_path / "bad.zip").write_bytes(data)
    with pytest.raises(PySparkException, match="hurt.txt"):
        archives.contents(found).collect()


def test_unreadable_and_large(spark, tmp_path):
    (tmp_path / "half.zip").write_bytes(b"PK\x03\x04 half a download" * 100)
    (tmp_path / "tiny.zip").write_bytes(b"P")
    make(tmp_path / "ok.zip", {"x": b"12345"})
    assert archives.index(spark, str(tmp_path), skip_unreadable=True).count() == 1
    with pytest.raises(PySparkException):
        archives.index(spark, str(tmp_path))
    found = archives.index(spark, str(tmp_path), skip_unreadable=True)
    with pytest.raises(ValueError, match="over 4 bytes: x"):
        archives.contents(found, 4)
    assert archives.contents(found.limit(0)).count() == 0


def test_packages_read_only_the_pages_of_their_granules(spark, tmp_path):
    part = "<relatedItem type='constituent' ID='id-{0}'><extension><granuleClass>HOUSE</granuleClass></extension></relatedItem>"
    mods = "<mods xmlns='http://x'><extension><congress>115</congress></extension>" + "".join(part.format(g) for g in ("g2", "g1", "lost", "g2")) + "</mods>"
    make(tmp_path / "CREC-2017-01-03.zip", {"mods.xml": mods, "html/g1.htm": "<pre>one</pre>", "html/g2.htm": "first", "other/g2.htm": b"caf\xe9 last", "html/unnamed.htm": "x", "pdf/g1.pdf": b"%"})
    make(tmp_path / "CREC-2017-01-04.zip", {"html/g1.htm": "no mods"})
    rows = packages.read_packages(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r["package"], r["place"], r["granule_id"], r["date"], r["text"], r["congress"]) for r in rows] == [
        ("CREC-2017-01-03", 0, "g2", "2017-01-03", "caf� last", 115), ("CREC-2017-01-03", 1, "g1", "2017-01-03", "<pre>one</pre>", 115),
    ]
