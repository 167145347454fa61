"""Following files that grow: a data source whose offsets are places in files and whose partitions are byte ranges.

``spark.readStream.format("tail").load(folder)`` (and ``read``) gives ``file, offset, line``: every whole line once,
however often a file grows. An offset of the stream holds, per file, the end of its last whole line; a micro-batch
opens only files that changed, at the place known, and reads each byte range in a task of its own. A line still
without its end waits. A file that is shorter than the place known, or whose first bytes are others, was replaced
and is read from its start. Vanished files are forgotten.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, offset bigint, line string"
SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
#: First bytes of a file by which it is known again.
HEAD_BYTES = 256
BATCH_LINES, BATCH_BYTES = 10_000, 8 << 20
_MARK = b"\xef\xbb\xbf"

# Workers that plan and read get this module's classes as they are, wherever they run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class ByteRange(InputPartition):
    """Lines that begin in [lo, hi) of what is read from ``start`` to ``end``, both at a line's edge."""

    path: str
    file: str
    lo: int
    hi: int
    start: int
    end: int


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if "://" in path:
        return stores.FileSystem.from_uri(path)
    return stores.LocalFileSystem(), path.removeprefix("file:")


def head_sum(store: stores.FileSystem, file: str, size: int) -> int:
    with store.open_input_stream(file) as f:
        return zlib.crc32(f.read(size) if size else b"")


def last_line_end(store: stores.FileSystem, file: str, size: int) -> int:
    """The place behind the last line end; only the blocks behind it are read."""
    with store.open_input_file(file) as f:
        while size > 0:
            at = max(0, size - BLOCK_BYTES)
            f.seek(at)
            found = f.read(size - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            size = at
    return 0


def places_now(path: str, known: dict) -> dict:
    """``{file: place}`` of the files under a path; files as they were at ``known`` are not opened."""
    store, root = store_of(path)
    found = {}
    for info in store.get_file_info(stores.FileSelector(root, recursive=True, allow_not_found=True)):
        if info.type != stores.FileType.File or info.base_name.startswith(("_", ".")):
            continue
        before = known.get(info.path)
        if before and (before["size"], before["changed"]) == (info.size, info.mtime_ns):
            found[info.path] = before
            continue
        head = min(info.size, HEAD_BYTES)
        found[info.path] = {
            "at": last_line_end(store, info.path, info.size), "size": info.size, "changed": info.mtime_ns or 0,
            "head": head, "sum": head_sum(store, info.path, head)}
    return found


def begins_at(store: stores.FileSystem, file: str, before: dict | None, now: dict) -> int:
    """Where to go on in a file: behind what is known of it, unless it is another file by now."""
    if before is None or now["at"] < before["at"] or now["size"] < before["size"]:
        return 0
    same = now["sum"] if now["head"] == before["head"] else head_sum(store, file, before["head"])
    return before["at"] if same == before["sum"] else 0


def ranges_between(path: str, start: dict, end: dict, split_bytes: int) -> list[ByteRange]:
    store, _ = store_of(path)
    ranges = []
    for file, now in sorted(end.items()):
        before = start.get(file)
        if before == now:
            continue
        first = begins_at(store, file, before, now)
        for lo in range(first, now["at"], split_bytes):
            ranges.append(ByteRange(path, file, lo, min(lo + split_bytes, now["at"]), first, now["at"]))
    return ranges


def lines_in(f, part: ByteRange) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in the range; the last one is read to its end."""
    begin, held = (part.lo, []) if part.lo == part.start else (None, [])
    at = part.lo if begin is not None else part.lo - 1  # a line begins behind a line's end
    f.seek(at)
    while at < part.end and (begin is not None or at < part.hi):
        block, done = f.read(min(BLOCK_BYTES, part.end - at)), 0
        if not block:
            return
        while (end := block.find(b"\n", done)) >= 0:
            if begin is not None:
                held.append(block[done:end])
                yield begin, b"".join(held)
            begin, held, done = at + end + 1, [], end + 1
            if begin >= part.hi:
                return
        if begin is not None:
            held.append(block[done:])
        at += len(block)


def read_range(part: ByteRange) -> Iterator[pa.RecordBatch]:
    store, _ = store_of(part.path)
    offsets, lines, size = [], [], 0

    def batch() -> pa.RecordBatch:
        texts = [x.decode("utf-8", "replace") for x in lines]
        return pa.RecordBatch.from_arrays(
            [pa.array([part.file] * len(lines), pa.string()), pa.array(offsets, pa.int64()), pa.array(texts, pa.string())],
            names=["file", "offset", "line"])

    with store.open_input_file(part.file) as f:
        for offset, line in lines_in(f, part):
            offsets.append(offset)
            lines.append(line.removeprefix(_MARK) if offset == 0 else line)
            size += len(line)
            if len(lines) >= BATCH_LINES or size >= BATCH_BYTES:
                yield batch()
                offsets, lines, size = [], [], 0
    if lines:
        yield batch()


class TailReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, start: dict, end: dict | None):
        self.path, self.split_bytes, self.start, self.end = path, split_bytes, start, end

    def partitions(self):
        end = places_now(self.path, self.start) if self.end is None else self.end
        return ranges_between(self.path, self.start, end, self.split_bytes) or [ByteRange(self.path, "", 0, 0, 0, 0)]

    def read(self, partition):
        return read_range(partition) if partition.end else iter([])


class TailStream(DataSourceStreamReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes, self.known = path, split_bytes, {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        self.known = places_now(self.path, self.known)
        return self.known

    def partitions(self, start, end):
        return ranges_between(self.path, start, end, self.split_bytes)

    def read(self, partition):
        return read_range(partition)


class Tail(DataSource):
    """Options: ``path``; ``splitBytes``; in batch ``start`` and ``end``, places as JSON."""

    @classmethod
    def name(cls):
        return "tail"

    def schema(self):
        return SCHEMA

    def _options(self):
        return self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES))

    def reader(self, schema):
        end = self.options.get("end")
        return TailReader(*self._options(), json.loads(self.options.get("start", "{}")), json.loads(end) if end else None)

    def streamReader(self, schema):
        return TailStream(*self._options())


def follow_files(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream of ``file, offset, line`` of growing files; its checkpoint holds the places."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").option("splitBytes", split_bytes).load(path)


def appended_lines(
    spark: SparkSession, path: str, seen: dict | None = None, split_bytes: int = SPLIT_BYTES,
) -> tuple[DataFrame, dict]:
    """The same in batch: what files have got since ``seen`` (an earlier second result), and the places now.

    The places, a few numbers a file, are those of this call, however late the frame is read.
    """
    spark.dataSource.register(Tail)
    now = places_now(path, seen or {})
    reader = spark.read.format("tail").option("splitBytes", split_bytes)
    return reader.option("start", json.dumps(seen or {})).option("end", json.dumps(now)).load(path), now
