"""ZIP archives as splittable input: a central-directory index, and members read by range.

An archive is never a row: :func:`index` reads only the directory at its end and gives a row a member, and those rows,
dealt out by size, are what tasks work on. A task opens an archive, seeks to a member and inflates it in pieces, so an
archive of any size is read by as many tasks as it has members, in bounded memory. A lost task rereads its members.
"""

from __future__ import annotations

import logging
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.scratch import stored
from lectern.sources.ranges import list_files, open_ranges

INDEX = "archive string, member string, place int, offset long, packed long, size long, method int, crc long, modified string"
_INDEX = pa.schema([("archive", pa.string()), ("member", pa.string()), ("place", pa.int32()), ("offset", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("method", pa.int32()), ("crc", pa.int64()), ("modified", pa.string())])
READ_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
#: Packed bytes that one task should read.
TASK_BYTES = 64 << 20
LINES_A_BATCH = 10_000


class DamagedArchive(ValueError):
    """A member whose bytes are not what the directory says."""


def _directories(skip_unreadable: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_ranges(path) as file:
                    try:
                        entries = zipfile.ZipFile(file).infolist()  # reads the directory at the end alone
                    except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter where a file is shorter than any directory
                        if not skip_unreadable:
                            raise
                        logging.getLogger(__name__).warning("not an archive: %s", path)
                        continue
                rows = [(path, e.filename, k, e.header_offset, e.compress_size, e.file_size, e.compress_type, e.CRC, "{:04d}-{:02d}-{:02d}T{:02d}:{:02d}:{:02d}".format(*e.date_time)) for k, e in enumerate(entries) if not e.is_dir()]
                for at in range(0, len(rows), LINES_A_BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + LINES_A_BATCH], strict=True), _INDEX, strict=True)], schema=_INDEX)

    return run


def index(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    """One row a member of every archive below ``path`` (INDEX), a stored table; folders in archives have none.

    A file that is no archive fails the job, or has no members if ``skip_unreadable``.
    """
    files = list_files(spark, path, "*.zip").select("path")
    return stored(files.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(_directories(skip_unreadable), INDEX), "archive-index")


def deal(members: DataFrame) -> DataFrame:
    """Members spread over enough tasks for their bytes, those of one archive in order in each task.

    There are as many tasks as the packed bytes need at ``TASK_BYTES`` each, and no fewer than the cluster has cores.
    """
    total = members.agg(F.coalesce(F.sum("packed"), F.lit(0))).first()[0]
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return members.repartition(int(tasks), "archive", "offset").sortWithinPartitions("archive", "offset")


def inflated(file, name: str, offset: int, packed: int, size: int, method: int, crc: int) -> Iterator[bytes]:
    """The pieces of one member, read from its local header on; its size and CRC are checked at the end."""
    file.seek(offset)
    header = file.read(30)
    if len(header) < 30 or header[:4] != b"PK\x03\x04" or method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise DamagedArchive(f"{name} cannot be read at {offset}")
    flags, named, extra = struct.unpack("<6xH18xHH", header)
    if flags & 1:
        raise DamagedArchive(f"{name} is encrypted")
    file.seek(offset + 30 + named + extra)
    inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
    left, made, check = packed, 0, 0
    while left:
        raw = file.read(min(READ_BYTES, left))
        if not raw:
            raise DamagedArchive(f"{name} is cut short")
        left -= len(raw)
        piece = inflate.decompress(raw) if inflate else raw
        made, check = made + len(piece), zlib.crc32(piece, check)
        yield piece
    if inflate:
        piece = inflate.flush()
        made, check = made + len(piece), zlib.crc32(piece, check)
        yield piece
    if (made, check) != (size, crc):
        raise DamagedArchive(f"{name} is not what its directory says")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """Each row with the pieces of its member; the file of the last archive stays open."""
    name, file = None, None
    try:
        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != name:
                    if file is not None:
                        file.close()
                    name, file = row["archive"], open_ranges(row["archive"])
                yield row, inflated(file, f"{row['member']} in {name}", *(row[k] for k in ("offset", "packed", "size", "method", "crc")))
    finally:
        if file is not None:
            file.close()


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return
    schema = first.schema.append(pa.field("content", pa.binary()))
    rows, size = [], 0

    def again() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    for row, pieces in _opened(again()):
        rows.append(row | {"content": b"".join(pieces)})
        size += len(rows[-1]["content"])
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def contents(members: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``members`` (rows of :func:`index`, with any further columns) and their ``content``.

    A member above ``max_bytes`` fails with its name before anything is read.
    """
    if max_bytes is not None:
        worst = members.filter(F.col("size") > max_bytes).select("archive", "member").first()
        if worst is not None:
            raise PySparkValueError(f"a member over {max_bytes} bytes: {worst['member']} in {worst['archive']}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema)
    return deal(members).mapInArrow(_contents, f"{fields}, content binary")


def _lines(encoding: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("pos", pa.int64()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, pieces in _opened(batches):
            pos, rest = 0, b""

            def made(raw: list[bytes], at: int, row: dict = row) -> pa.RecordBatch:
                text = [x.removesuffix(b"\r").decode(encoding) for x in raw]
                return pa.RecordBatch.from_arrays([pa.array([row["archive"]] * len(text)), pa.array([row["member"]] * len(text)), pa.array(range(at, at + len(text)), pa.int64()), pa.array(text, pa.string())], schema=schema)

            for piece in pieces:
                *whole, rest = (rest + piece).split(b"\n") if b"\n" in piece else (rest + piece,)
                for k in range(0, len(whole), LINES_A_BATCH):
                    part = whole[k : k + LINES_A_BATCH]
                    yield made(part, pos)
                    pos += len(part)
            if rest:
                yield made([rest], pos)

    return run


def lines(members: DataFrame, encoding: str = "latin-1") -> DataFrame:
    """(archive, member, pos, line) of text members, in pieces; a line end at the end of a member begins no line."""
    return deal(members).mapInArrow(_lines(encoding), "archive string, member string, pos long, line string")


def base_name(member: Column) -> Column:
    return F.element_at(F.split(member, "/"), -1)
