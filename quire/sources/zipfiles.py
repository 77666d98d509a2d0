"""Archives of any size, read where they lie: the directory entry by entry, contents by ranges of the file.

``files``: path, length of files in a folder that all executors share, as ``packages.save`` writes them.  No task holds an archive
or its directory, and none unpacks all of an archive; archives in rows, by any path Spark can open, are in ``archives``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from zipfile import BadZipFile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.archives import bounded, described

STORED, DEFLATED, UTF8 = 0, 8, 0x800
#: Bytes read at once, and bits of a place in an archive within the range that a task unpacks as one.
BLOCK, RANGE = 1 << 20, 24
#: Bytes of archives to a task.
SHARE = 1 << 26
MAX32 = 0xFFFFFFFF


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of every file; nothing is read of it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def _open(path: str) -> BinaryIO:
    return open(re.sub(r"^file:(//(?=/))?", "", path), "rb", buffering=BLOCK)  # noqa: SIM115


def _begin(f: BinaryIO) -> tuple[int, int, int]:
    """Where the directory begins and ends, and what its places don't count of the file."""
    length = f.seek(0, 2)
    f.seek(start := max(0, length - 22 - 0xFFFF))
    tail = f.read()
    at = tail.rfind(b"PK\5\6")
    if at < 0 or len(tail) < at + 22:
        raise BadZipFile("no end of a directory")
    size, offset = struct.unpack_from("<II", tail, at + 12)
    end = start + at
    f.seek(max(0, end - 76))
    far = f.read(min(end, 76))
    if len(far) == 76 and far[:4] == b"PK\6\6" and far[56:60] == b"PK\6\7":
        size, offset = struct.unpack_from("<QQ", far, 40)
        end -= 76
    if end - size - offset < 0:
        raise BadZipFile("the directory is cut")
    return end - size, end, end - size - offset


def directory(f: BinaryIO) -> Iterator[tuple]:
    """pos, entry, size, compressed, crc, place, method of each entry, folders too."""
    at, end, before = _begin(f)
    f.seek(at)
    pos = 0
    while at < end:
        head = f.read(46)
        if len(head) < 46 or head[:4] != b"PK\1\2":
            raise BadZipFile("no entry in the directory")
        flags, method, crc, packed, size, n, m, k = struct.unpack_from("<HH4xIIIHHH", head, 8)
        place = int.from_bytes(head[42:46], "little")
        rest = f.read(n + m + k)
        if len(rest) < n + m + k:
            raise BadZipFile("the directory is cut")
        if MAX32 in (size, packed, place):
            size, packed, place = _far(rest[n : n + m], [size, packed, place])
        name = rest[:n].decode("utf-8" if flags & UTF8 else "cp437", "replace")
        yield pos, name, size, packed, crc, before + place, method
        at, pos = at + 46 + len(rest), pos + 1


def _far(extra: bytes, values: list[int]) -> list[int]:
    """Values that 32 bits don't hold, from the extra field."""
    while len(extra) >= 4:
        kind, n = struct.unpack_from("<HH", extra)
        if kind == 1:
            more = iter(struct.unpack_from(f"<{min(n, len(extra) - 4) // 8}Q", extra, 4))
            return [next(more, v) if v == MAX32 else v for v in values]
        extra = extra[4 + n :]
    return values


def unpacked(f: BinaryIO, size: int, compressed: int, crc: int, place: int, method: int) -> Iterator[bytes]:
    """An entry's bytes, block by block."""
    f.seek(place)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\3\4" or method not in (STORED, DEFLATED):
        raise BadZipFile(f"no entry that can be read at {place}")
    f.seek(sum(struct.unpack_from("<HH", head, 26)), 1)
    inflate, left, found, total = zlib.decompressobj(-15), compressed, 0, 0
    try:
        while left:
            block = f.read(min(left, BLOCK))
            if not block:
                raise BadZipFile(f"the entry at {place} is cut")
            left -= len(block)
            while block:
                data, block = (block, b"") if method == STORED else (inflate.decompress(block, BLOCK), inflate.unconsumed_tail)
                found, total = zlib.crc32(data, found), total + len(data)
                yield data
    except zlib.error as e:
        raise BadZipFile(f"the entry at {place}: {e}") from e
    if method == DEFLATED:
        data = inflate.flush()
        found, total = zlib.crc32(data, found), total + len(data)
        yield data
    if (found, total) != (crc, size):
        raise BadZipFile(f"the entry at {place} isn't what its check sum says")


LISTED = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("entry", pa.string()), ("size", pa.int64()), ("compressed", pa.int64()), ("crc", pa.int64()), ("place", pa.int64()), ("method", pa.int32())])


def _batches(rows: Iterable[tuple], schema: pa.Schema, size=lambda row: 100) -> Iterator[pa.RecordBatch]:
    for some in bounded(iter(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def listing(files: DataFrame) -> DataFrame:
    """One row per entry of each archive from its directory, folders too; archives that can't be read have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            with _open(path) as f:
                # The whole directory is looked at before any of it is given.
                if _count(f):
                    yield from _batches(((path, *row) for row in directory(f)), LISTED)

    return files.select("path").mapInArrow(read, "path string, pos long, entry string, size long, compressed long, crc long, place long, method int")


def _count(f: BinaryIO) -> int:
    """Entries of an archive, 0 of one that can't be read."""
    try:
        return sum(1 for _ in directory(f))
    except BadZipFile:
        return 0


ENTRIES = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("entry", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


def entries(files: DataFrame, chosen: Column | None = None) -> DataFrame:
    """One row per file (``entry``) of each archive, of those that ``chosen`` is true of; ranges of an archive go to different tasks.

    Archives without a directory have none; an entry that isn't what its check sum says is an error.
    """
    found = listing(files).where(~F.col("entry").endswith("/"))
    found = found if chosen is None else found.where(chosen)
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SHARE + 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            here, f = None, None
            try:
                for batch in batches:
                    for path, pos, entry, *where in zip(*(batch.column(c).to_pylist() for c in LISTED.names), strict=True):
                        if path != here:
                            if f is not None:
                                f.close()
                            here, f = path, _open(path)
                        yield path, pos, entry, where[0], b"".join(unpacked(f, *where))
            finally:
                if f is not None:
                    f.close()

        yield from _batches(rows(), ENTRIES, lambda row: len(row[-1]))

    dealt = found.repartition(tasks, "path", F.shiftright("place", RANGE)).sortWithinPartitions("path", "place")
    return dealt.select(*LISTED.names).mapInArrow(read, "path string, pos long, entry string, size long, content binary")


_MARKS = re.compile(rb'["\\\[\]{}]')


def outer(blocks: Iterable[bytes]) -> bytes:
    """A JSON object, read block by block, with nulls where its values are arrays or objects: those aren't kept or looked into."""
    out, depth, quoted, base, escaped = bytearray(), 0, False, 0, -1
    for block in blocks:
        begin = 0 if depth < 2 else None
        for mark in _MARKS.finditer(block):
            at, c = mark.start(), mark[0]
            if base + at == escaped:
                continue
            if quoted:
                if c == b"\\":
                    escaped = base + at + 1
                quoted = c != b'"'
            elif c == b'"':
                quoted = True
            elif c in b"[{":
                depth += 1
                if depth == 2:
                    out += block[begin:at]
                    begin = None
            elif c in b"]}":
                depth -= 1
                if depth == 1:
                    out += b"null"
                    begin = at + 1
        if begin is not None:
            out += block[begin:]
        base += len(block)
    return bytes(out)


RECORDS = pa.schema([("path", pa.string()), ("sha256", pa.string()), ("size_bytes", pa.int64()), ("file_count", pa.int64()), ("told", pa.binary())])


def _records(files: DataFrame, name: str | None) -> DataFrame:
    """path, sha256, size_bytes, file_count of each archive, 0 entries for one that can't be read; told is the outer JSON of its entry ``name``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            with _open(path) as f:
                digest = hashlib.file_digest(f, "sha256").hexdigest()
                size, count, told = f.tell(), _count(f), None
                row = next((row for row in directory(f) if row[1] == name), None) if count and name is not None else None
                if row is not None:
                    try:
                        told = outer(unpacked(f, *row[2:]))
                    except BadZipFile:
                        told = None
            yield from _batches([(path, digest, size, count, told)], RECORDS)

    return files.select("path").mapInArrow(read, "path string, sha256 string, size_bytes long, file_count long, told binary")


def archive_records(files: DataFrame) -> DataFrame:
    """As ``archives.archive_records``."""
    return _records(files, None).drop("told")


def package_manifests(files: DataFrame, project: Column) -> DataFrame:
    """As ``archives.package_manifests``."""
    return described(_records(files, "pgdp.json"), F.decode("told", "utf-8"), project)
